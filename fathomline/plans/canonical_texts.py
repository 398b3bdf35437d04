"""Canonical JSON of JSON texts as Column expressions: no Python worker, and no value is taken apart more than once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomline.functions.vocab import MAX_SAFE_INTEGER

from .columns import let, number_text

#: Repetitions are possessive: Java takes them in a loop, so a text's length costs no stack.
_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{}:,]|[^\[\]{}:,"\s]++'
_INNERMOST = r"[{\[][^{}\[\]]*+[}\]]|[^{}\[\]]++|[{}\[\]]"
_PART = r'"[0-9A-F]*+!|#[0-9]++|.'
_PAIRS = r"\\\\|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}"
#: Levels that Spark's JSON parser reads.
_LEVELS = 1000
_SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _string(token: Column) -> Column:
    """What a string's token says."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.contains(token, F.lit("\\")), F.try_variant_get(F.try_parse_json(token), "$", "string")).otherwise(plain)


def _spelled(s: Column) -> Column:
    """A string as canonical JSON: only quotes, backslashes and control characters are escaped."""
    escaped = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escapes = F.array(*[F.array(F.lit(chr(k)), F.lit(_SHORT.get(chr(k), f"\\u{k:04x}"))) for k in range(32)])
    controls = F.aggregate(escapes, escaped, lambda text, e: F.replace(text, F.get(e, F.lit(0)), F.get(e, F.lit(1))))
    return F.concat(F.lit('"'), F.when(F.rlike(s, F.lit(r"[\x00-\x1f]")), controls).otherwise(escaped), F.lit('"'))


def _subnormal(x: Column) -> Column:
    """A double of less than 15 digits of precision in the fewest digits that read back as it."""
    tried = F.transform(F.sequence(F.lit(0), F.lit(16)), lambda n: F.call_function("format_string", F.concat(F.lit("%."), n.cast("string"), F.lit("e")), x))
    return F.regexp_replace(F.get(F.filter(tried, lambda t: t.try_cast("double") == x), F.lit(0)), r"\.?0*e", "e")


def _number(token: Column) -> Column:
    """null for integers beyond the safe range, however long, and for what is beyond all doubles."""
    whole = let(token.try_cast("decimal(38,0)"), lambda n: F.when(F.abs(n) <= MAX_SAFE_INTEGER, n.cast("string")))
    tiny = lambda x: (x != 0) & (F.abs(x) < 2.2250738585072014e-308)
    real = let(token.try_cast("double"), lambda x: F.when(tiny(x), _subnormal(x)).when(F.abs(x) < float("inf"), number_text(x)))
    return F.when(F.rlike(token, F.lit(r"[.eE]")), real).otherwise(whole)


def _leaf(token: Column) -> Column:
    spelled = F.when(F.startswith(token, F.lit('"')), _spelled(_string(token)))
    return spelled.when(token.isin("true", "false", "null"), token).otherwise(_number(token))


def _outline(tokens: Column) -> Column:
    """The text with each leaf as the number of its token, and each key as the digits of its UTF-16BE bytes, which sort as its
    code units do, with an end that sorts before them."""

    def part(token: Column, i: Column) -> Column:
        key = F.get(tokens, i + 1) == ":"
        return (
            F.when(token == ":", F.lit("")).when(F.length(token) == 1, F.when(token.isin(*"{}[],"), token).otherwise(F.concat(F.lit("#"), i.cast("string"))))
            .when(key, F.concat(F.lit('"'), F.hex(F.encode(_string(token), "UTF-16BE")), F.lit("!"))).otherwise(F.concat(F.lit("#"), i.cast("string")))
        )

    return F.array_join(F.transform(tokens, part), "")


def _closed(outline: Column) -> Column:
    """The outline with the innermost arrays and objects closed: members sorted, signs exchanged for ones that those around
    it do not look for."""

    def close(part: Column) -> Column:
        inner = F.substring(part, F.lit(2), F.length(part) - 2)
        members = F.array_join(F.array_sort(F.split(inner, ",")), ";")
        both = F.length(part) > 1
        return F.when(both & F.startswith(part, F.lit("{")), F.concat(F.lit("<"), members, F.lit(">"))).when(
            both & F.startswith(part, F.lit("[")), F.concat(F.lit("("), F.translate(inner, ",", ";"), F.lit(")"))
        ).otherwise(part)

    return F.array_join(F.transform(_all(outline, _INNERMOST), close), "")


def canonical_text(text: Column | str) -> Column:
    """Canonical JSON of a column of JSON texts: keys by UTF-16 code unit, numbers as ECMAScript spells them.

    Built from the leaves up, level by level. null for null and for what has no such form: what is no JSON text, integers
    beyond the safe range, numbers beyond all doubles, lone surrogates, an object with the same key twice, and values nested
    deeper than Spark's parser reads. Work grows with the text's length times its depth; strings are looked at once."""
    text = F.col(text) if isinstance(text, str) else text

    def of(given: Column) -> Column:
        lone = F.contains(given, F.lit("\\u")) & F.rlike(F.regexp_replace(given, _PAIRS, " "), F.lit(r"\\u[dD][89a-fA-F]"))
        # in brackets, as the parser does not mind what follows a value
        sound = F.try_parse_json(F.concat(F.lit("["), given, F.lit("]"))).isNotNull() & ~lone
        return F.when(sound, let(_all(given, _TOKEN), made))

    def made(tokens: Column) -> Column:
        opened = F.size(F.filter(tokens, lambda t: t.isin("{", "[")))
        open_ = lambda s: F.startswith(s, F.lit("{")) | F.startswith(s, F.lit("["))
        levels = F.sequence(F.lit(0), F.least(opened, F.lit(_LEVELS)))
        closed = F.aggregate(levels, _outline(tokens), lambda s, _: F.when(open_(s), _closed(s)).otherwise(s))
        one = lambda s: F.rlike(s, F.lit(r"^[^,\[\]{}]+$"))
        return let(closed, lambda s: F.when(one(s), let(F.transform(_all(s, _PART), lambda p: part(tokens, p)), whole)))

    def part(tokens: Column, p: Column) -> Column:
        rest = F.substring(p, F.lit(2), F.length(p))
        key = F.concat(_spelled(F.decode(F.unhex(F.rtrim(rest, F.lit("!"))), "UTF-16BE")), F.lit(":"))
        return F.when(F.startswith(p, F.lit("#")), _leaf(F.get(tokens, rest.cast("int")))).when(F.startswith(p, F.lit('"')), key).otherwise(F.translate(p, "<>();", "{}[],"))

    def whole(parts: Column) -> Column:
        return F.when(~F.exists(parts, lambda p: p.isNull()), F.array_join(parts, ""))

    return let(text, of)
