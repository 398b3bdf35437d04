"""The opN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op7_byte_bpe
from .decontaminate import op4_decontaminate
from .embedding_dedup import OP3_SQL, op3_embedding_dedup
from .html_text import op8_html_text
from .jaccard_join import OP1_SQL, op1_jaccard_join
from .licenses import op9_license_scan
from .line_dedup import OP2_SQL, op2_line_dedup
from .prefix_trie import OP13_SQL, op13_prefix_trie
from .quality import op6_quality
from .resampling import OP11_SQL, op11_resample
from .secret_scan import OP12_SQL, op12_secret_scan
from .toxicity import op10_toxicity
from .warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_line_dedup": op2_line_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_html_text": op8_html_text,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_resample": op11_resample,
    "op12_secret_scan": op12_secret_scan,
    "op13_prefix_trie": op13_prefix_trie,
}
SQL = {
    "op1_jaccard_join": OP1_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op5_warc": OP5_SQL,
    "op11_resample": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
