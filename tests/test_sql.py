import math

import pytest

from textquarry.functions.sql import register_functions, register_tables
from textquarry.functions.tokens import tokenize
from textquarry.operators.answering import ExtractiveGenerator
from textquarry.operators.dense import HashEncoder, embed
from textquarry.operators.models import ChatGenerator, SentenceEncoder, make_encoder, make_generator


def test_functions(spark, tmp_path):
    names = register_functions(spark)
    assert {"code_tokens", "bm25_idf", "span_iou"} <= set(names)
    from pyspark.sql import functions as F

    texts = ["getURLFor2X a__b", "camelCase __init__", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    df.write.parquet(str(tmp_path / "texts.parquet"))
    register_tables(spark, str(tmp_path), ["texts"])
    want = [list(r.x) for r in df.select(tokenize(F.col("t")).alias("x")).collect()]
    assert sorted(list(r.x) for r in spark.sql("SELECT code_tokens(t) AS x FROM texts").collect()) == sorted(want)
    one = spark.sql(
        "SELECT bm25_idf(3, 1) AS i, bm25_part(3, 1, 2, 3, 3.0D, 1.2D, 0.5D) AS p, text_slice('a😀bc', 1, 3) AS t,"
        " dot_product(array(1.0F, 2.0F), array(3.0F, 0.5F)) AS d,"
        " span_iou(named_struct('file_path', 'f', 'first_character_index', 0L, 'last_character_index', 100L),"
        " named_struct('file_path', 'f', 'first_character_index', 50L, 'last_character_index', 150L)) AS o"
    ).first()
    assert math.isclose(one.i, math.log(2.5 / 1.5 + 1)) and math.isclose(one.p, one.i * 2 * 2.2 / 3.2)
    assert (one.t, one.d) == ("😀b", 4.0) and math.isclose(one.o, 1 / 3)


def test_models_say_what_is_missing():
    for call in (lambda: SentenceEncoder("m", 4).encode(["x"]), lambda: ChatGenerator("m").generate("x")):
        with pytest.raises(Exception):
            call()


FAKE = """
import numpy as np

class SentenceTransformer:
    def __init__(self, name):
        self.name = name

    def encode(self, texts, normalize_embeddings, show_progress_bar):
        assert self.name == "some/model" and normalize_embeddings
        return np.asarray([[len(t), 1.0] for t in texts], np.float32)
"""


def test_choice_of_models(spark, tmp_path):
    assert isinstance(make_encoder(None), HashEncoder) and make_encoder("hash:16").dim == 16
    assert isinstance(make_generator("extract"), ExtractiveGenerator)
    chat = make_generator("chat:some/model", 42)
    assert (chat.model, chat.max_new_tokens) == ("some/model", 42)
    for bad in ("sentence:x", "other", "sentence::3"):
        with pytest.raises(ValueError):
            make_encoder(bad)
    with pytest.raises(ValueError):
        make_generator("chat")
    (tmp_path / "sentence_transformers.py").write_text(FAKE)
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    rows = embed(spark.createDataFrame([(1, "abc"), (2, None)], "chunk_ord long, text string"), make_encoder("sentence:some/model:2"), "chunk_ord", "text")
    assert sorted((r.chunk_ord, list(r.embedding)) for r in rows.collect()) == [(1, [3.0, 1.0]), (2, [0.0, 1.0])]
