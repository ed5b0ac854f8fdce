"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from timberline.llm import lines, minhash, mixing, quality, repeats, vectors, warc
from timberline.llm.bpe import op1_bpe
from timberline.llm.language import op2_language
from timberline.llm.lines import op9_lines
from timberline.llm.minhash import op5_minhash
from timberline.llm.mixing import op3_mixing
from timberline.llm.quality import op7_quality
from timberline.llm.repeats import op10_repeats
from timberline.llm.secrets import op8_secrets
from timberline.llm.vectors import op4_vectors
from timberline.llm.warc import op6_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_mixing": op3_mixing,
    "op4_vectors": op4_vectors,
    "op5_minhash": op5_minhash,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_secrets": op8_secrets,
    "op9_lines": op9_lines,
    "op10_repeats": op10_repeats,
}

ORACLES: dict[str, str] = {
    "op3_mixing": mixing.ORACLE_SQL,
    "op4_vectors": vectors.ORACLE_SQL,
    "op5_minhash": minhash.ORACLE_SQL,
    "op6_warc": warc.ORACLE_SQL,
    "op7_quality": quality.ORACLE_SQL,
    "op9_lines": lines.ORACLE_SQL,
    "op10_repeats": repeats.ORACLE_SQL,
}
