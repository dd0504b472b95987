"""The queries of this package and their SQL."""

from __future__ import annotations

from . import langid, main_text, media_jpeg, minhash, mixing, packing, rp_forest, token_sst, url_graph, warc

QUERIES = {
    "op1_media_jpeg": media_jpeg.op1_media_jpeg,
    "op2_token_sst": token_sst.op2_token_sst,
    "op3_minhash": minhash.op3_minhash,
    "op4_url_graph": url_graph.op4_url_graph,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": warc.op6_warc,
    "op7_main_text": main_text.op7_main_text,
    "op8_langid": langid.op8_langid,
    "op9_rp_forest": rp_forest.op9_rp_forest,
    "op10_packing": packing.op10_packing,
}

ORACLES: dict[str, str] = {
    "op4_url_graph": url_graph.SQL,
    "op5_mixing": mixing.SQL,
    "op6_warc": warc.SQL,
    "op10_packing": packing.SQL,
}
