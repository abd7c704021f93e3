"""The queries of this subpackage and the SQL that checks them."""

from . import ann, mixing, mpeg_audio, ngram_join, packing, pii, quality, quotes, secrets, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_media_columns": mpeg_audio.op2_media_columns,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_secrets": secrets.op4_secrets,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_quality": quality.op6_quality,
    "op7_pack": packing.op7_pack,
    "op8_pii": pii.op8_pii,
    "op9_quotes": quotes.op9_quotes,
    "op10_warc": warc.op10_warc,
}

ORACLE_SQL = {"op10_warc": warc.OP10_SQL}
