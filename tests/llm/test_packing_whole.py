"""Added tokens in texts."""

import zlib

import numpy as np
from test_operators import docs_of

from quarry.llm import packing, queries


def test_packing_query_equals_default_tokenizer(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(1, "a <|endoftext|> b", "s"), (2, "<|endoftext|>", "s"), (3, "x  <|endoftext|><|endoftext|>\n y<|endoftext", "s"), (4, "plain  text", "s"), (5, None, "s")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op7_best_fit_packing(spark, str(tmp_path)).collect()
    t = Tokenizer.from_file(queries.vocabulary())
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [packing.END], "<u4") for i, x, _ in rows}
    assert ids[1].tolist() == [64, 220, 50256, 275, packing.END]
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}
