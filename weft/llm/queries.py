"""The corpus queries that ``__spark_entry__`` registers, and their SQL."""

from __future__ import annotations

from . import dom, merges, prefixes, quality, rabitq, rangecoder, simhash, suffix, tiling, urls

QUERIES = {
    "op1_suffix": suffix.op1_suffix,
    "op2_rabitq": rabitq.op2_rabitq,
    "op3_tiling": tiling.op3_tiling,
    "op4_rangecoder": rangecoder.op4_rangecoder,
    "op5_prefixes": prefixes.op5_prefixes,
    "op6_merges": merges.op6_merges,
    "op7_simhash": simhash.op7_simhash,
    "op8_urls": urls.op8_urls,
    "op9_dom": dom.op9_dom,
    "op10_quality": quality.op10_quality,
}

#: The others hash, learn, search or code in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_rabitq": rabitq.OP2_SQL, "op8_urls": urls.OP8_SQL}
