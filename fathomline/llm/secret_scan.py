"""Secret scans: secrets that show by themselves, and parts of credentials that only count together.

Regular expressions find parts in each text. Plain secrets (assignments, access identifiers, long hexadecimal runs) are
reported as they stand. Weak candidates (log-in names, short or unnamed secrets, endpoints) are common in clean text, so
each is reported only where the parts that make it a credential stand nearby in the same scope: an interval join of the
parts' places, by stretches as long as the reach, in which parts can't lie closer than they are long.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import P, cut, sole, table

# The kinds of plain secrets, in order, and what they look like.
BASE = ("assign", "access", "hex")
NAMES = "password|passwd|secret|token|api_?key"
IS = r"""["']?\x20*[:=]\x20*["']?"""
VALUE = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
MIN_VALUE = 8
#: Weak candidates, in order after BASE: names in log-ins, assigned values that are too short for `assign`, unnamed keys, places to log in to.
WEAK = ("login", "short", "key", "endpoint")
LOGINS = "user_?name|user_?id|user|login|account_?id|account|client_?id"
LOGIN_VALUE = "[A-Za-z0-9@+/_.-]{3,}"
#: A run of these characters is a key if it is one as a whole and has letters of either case and digits.
RUN = "[A-Za-z0-9+/_=-]{20,}"
KEY = "[A-Za-z0-9+/_-]{20,}={0,2}"
HOSTS = "host_?name|host|server|endpoint"
URL = r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x00-\x20"'<>]{3,}"""
HOST_VALUE = r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+(?::[0-9]{1,5})?"
ADDRESS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}:[0-9]{1,5}\b"
BREAK = r"\n[\x20\t\r]*\n[\x20\t\r\n]*"


def _either(words: str) -> str:
    """A pattern of these letters in either case, ASCII only."""
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", words)


ASSIGN = f"({_either(NAMES)}){IS}({VALUE})"
LOGIN = f"(?:{_either(LOGINS)}){IS}{LOGIN_VALUE}"
ENDPOINT = f"{URL}|(?:{_either(HOSTS)}){IS}{HOST_VALUE}|{ADDRESS}"
_ASSIGN, _ACCESS, _HEX, _LOGIN, _RUN, _KEY, _ENDPOINT, _BREAK = (re.compile(p, re.A) for p in (ASSIGN, ACCESS, HEX, LOGIN, RUN, KEY, ENDPOINT, BREAK))
#: Which part of a credential a kind is.
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "short": "secret", "key": "secret", "endpoint": "endpoint"}
KINDS = (*BASE, *WEAK)
PART = "struct<start:int,stop:int,kind:int,scope:int>"
_ARROW_PART = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.int32()), ("scope", pa.int32())])


@dataclass(frozen=True)
class Reach:
    """chars: how far apart two parts of a credential may begin, within a scope, which ends at an empty line."""

    chars: int = 400


def _any(low: str, words: tuple[str, ...]) -> bool:
    return any(w in low for w in words)


def _is_key(run: str) -> bool:
    return bool(_KEY.fullmatch(run)) and any(c.isupper() for c in run) and any(c.islower() for c in run) and any(c.isdigit() for c in run)


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, number in KINDS, scope) of each part in the text, by start, then kind; places are code points."""
    found: list[tuple[int, int, int]] = []
    low = text.lower() if "=" in text or ":" in text else ""
    if _any(low, ("passw", "secret", "token", "key")):
        found += [(*m.span(), 0 if m.end(2) - m.start(2) >= MIN_VALUE else 4) for m in _ASSIGN.finditer(text)]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), 2) for m in _HEX.finditer(text)]
    plain = sorted(found)
    if _any(low, ("user", "login", "account", "client")):
        found += [(*m.span(), 3) for m in _LOGIN.finditer(text)]
    if low:
        found += [(*m.span(), 6) for m in _ENDPOINT.finditer(text)]
    at = 0
    for m in _RUN.finditer(text):
        if _is_key(m[0]):
            while at < len(plain) and plain[at][1] <= m.start():
                at += 1
            if at == len(plain) or plain[at][0] >= m.end():  # what another pattern covers is no part of its own
                found.append((*m.span(), 5))
    if not found:
        return []
    out, scope, stops = [], 0, [m.start() for m in _BREAK.finditer(text)]
    for start, end, kind in sorted(found, key=lambda x: (x[0], x[2])):
        while scope < len(stops) and stops[scope] < start:
            scope += 1
        out.append((start, end, kind, scope))
    return out


def _parts(text: Column) -> Column:
    @F.arrow_udf(f"array<{PART}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(([dict(zip(("start", "stop", "kind", "scope"), p, strict=True)) for p in parts(t.as_py() or "")] for t in batch), pa.list_(_ARROW_PART))

    return run(text)


def linked(rows: DataFrame, reach: Reach = Reach()) -> DataFrame:
    """row, start, stop, kind, scope of the weak parts among rows (those columns) whose complements are near.

    A secret needs an identifier, a log-in name needs a secret, an endpoint needs both: each in the same scope of the same row, beginning at most
    reach.chars before or after. A part meets those of its own stretch of reach.chars and of the two beside it."""
    roles = F.array(*[F.lit(ROLES[k]) for k in KINDS])[F.col("kind")]
    held = rows.select("*", roles.alias("role"), F.expr(f"start div {reach.chars}").cast("int").alias("bin"))

    def near(some: DataFrame, role: str) -> DataFrame:
        bins = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))
        there = held.where(F.col("role") == role).select(F.col("row").alias("row_"), F.col("scope").alias("scope_"), F.col("start").alias("start_"), bins.alias("bin_"))
        same = (F.col("row") == F.col("row_")) & (F.col("scope") == F.col("scope_")) & (F.col("bin") == F.col("bin_"))
        return some.join(there, same & (F.abs(F.col("start") - F.col("start_")) <= reach.chars), "left_semi")

    weak = held.where(F.col("kind") >= len(BASE))
    secrets = near(weak.where("role = 'secret'"), "identifier")
    logins = near(weak.where("role = 'identifier'"), "secret")
    endpoints = near(near(weak.where("role = 'endpoint'"), "identifier"), "secret")
    return secrets.union(logins).union(endpoints).select("row", "start", "stop", "kind", "scope")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: Reach = Reach()) -> DataFrame:
    """A row per row of docs: id (under its name), spans: array of (start, stop, kind, scope) of what is reported, by start, then kind (as in KINDS), then end.

    Places are code points of the whole text, the end exclusive. Plain secrets are always reported, one kind's spans don't overlap;
    weak ones as in linked(). Null and empty texts, and texts without parts, give an empty array. Rows that repeat an id, or
    have none, are scanned each for itself; an empty table gives an empty one; other columns of docs are not read."""
    found = cut(
        sole(docs, {"id": id_col, "t": text_col}).select("id", _parts(F.coalesce(F.col("t").cast("string"), F.lit(""))).alias("parts"))
        .withColumn("row", F.monotonically_increasing_id()),
        "secret-parts",
    )
    weak = F.exists("parts", lambda p: p["kind"] >= len(BASE))
    extra = linked(found.where(weak).select("row", F.inline("parts")), reach)
    extra = extra.groupBy("row").agg(F.collect_list(F.struct("start", "stop", "kind", "scope")).alias("extra"))
    plain = F.filter("parts", lambda p: p["kind"] < len(BASE))
    both = F.concat(plain, F.coalesce("extra", F.array().cast(f"array<{PART}>")))
    in_order = F.array_sort(F.transform(both, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["stop"].alias("stop"), p["scope"].alias("scope"))))
    spans = F.transform(in_order, lambda p: F.struct(p["start"], p["stop"], F.array(*[F.lit(k) for k in KINDS])[p["kind"]].alias("kind"), p["scope"]))
    return found.join(extra, "row", "left").select(F.col("id").alias(id_col), spans.alias("spans"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secret_scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return done.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _spans(name: str, pattern: str, group: int = 0) -> str:
    """SQL for doc, start, stop, value of each match of a pattern; value: a group of it."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT doc, (sum(len(piece)) OVER w + coalesce(sum(len(hit)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, start + len(hit) AS stop, value
  FROM (SELECT doc, unnest(range(len(hits))) AS k, unnest(pieces[:len(hits)]) AS piece, unnest(hits) AS hit, unnest(vals) AS value
        FROM (SELECT doc, regexp_split_to_array(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS hits, regexp_extract_all(t, '{p}', {group}) AS vals FROM d))
  WINDOW w AS (PARTITION BY doc ORDER BY k))"""


def _near(kind: str, roles: tuple[str, ...], reach: int) -> str:
    """SQL for the weak parts of a role beside which there are parts of others."""
    return f"SELECT * FROM p WHERE weak AND role = '{kind}' AND " + " AND ".join(
        f"EXISTS (SELECT 1 FROM p q WHERE q.doc = p.doc AND q.scope = p.scope AND q.role = '{r}' AND abs(q.start - p.start) <= {reach})" for r in roles
    )


OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS t FROM documents),
{_spans("assigned", ASSIGN, 2)},
{_spans("accesses", ACCESS)},
{_spans("hexes", HEX)},
{_spans("logins", LOGIN)},
{_spans("runs", RUN)},
{_spans("endpoints", ENDPOINT)},
{_spans("breaks", BREAK)},
plain AS (
  SELECT doc, start, stop, CASE WHEN len(value) >= {MIN_VALUE} THEN 0 ELSE 4 END AS kind FROM assigned
  UNION ALL SELECT doc, start, stop, 1 FROM accesses UNION ALL SELECT doc, start, stop, 2 FROM hexes),
every AS (
  SELECT * FROM plain UNION ALL SELECT doc, start, stop, 3 FROM logins UNION ALL SELECT doc, start, stop, 6 FROM endpoints
  UNION ALL SELECT doc, start, stop, 5 FROM runs r WHERE regexp_full_match(value, '{KEY}') AND regexp_matches(value, '[A-Z]')
    AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[0-9]')
    AND NOT EXISTS (SELECT 1 FROM plain q WHERE q.doc = r.doc AND q.start < r.stop AND r.start < q.stop)),
p AS (SELECT *, ({list(KINDS)})[kind + 1] AS name, ({[ROLES[k] for k in KINDS]})[kind + 1] AS role, kind >= {len(BASE)} AS weak,
        (SELECT count(*) FROM breaks b WHERE b.doc = e.doc AND b.start < e.start) AS scope FROM every e),
told AS (SELECT * FROM p WHERE NOT weak UNION ALL {_near("secret", ("identifier",), Reach().chars)}
  UNION ALL {_near("identifier", ("secret",), Reach().chars)} UNION ALL {_near("endpoint", ("identifier", "secret"), Reach().chars)})
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (NOT weak), '')) AS base_sha256,
  coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN told USING (doc) GROUP BY doc, doc_id
"""
