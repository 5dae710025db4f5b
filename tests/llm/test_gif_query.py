"""op6 reads what it stores through the general LZW decoder."""

import hashlib

from tessera.llm import gif


def test_query_stores_true_lzw(spark, tmp_path):
    texts = ["", "ab" * 3000, "é line\n" * 40, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in gif.op6_gif(spark, str(tmp_path)).collect()}
    assert len(out) == len(texts)
    for i, t in enumerate(texts):
        payload = gif.payload_of((t or "").encode())
        media = gif.encode(gif.as_frames(payload))
        assert (out[i].media_bytes, out[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        assert (out[i].payload_bytes, out[i].payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
    assert out[1].media_bytes < 3000
