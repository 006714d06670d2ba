import random

import pytest

from linemill.llm import token_counts as T
from linemill.llm.scratch import shared_dir


def test_query_takes_groups_with_tokens_off_and_adds_them_again(spark, monkeypatch, tmp_path):
    rows = [("a", "de", "eins, zwei2 ..."), ("a", "en", "one two three"), ("b", "de", "drei"), ("b", None, "x \u00e9y"), ("b", "en", ""), ("b", "en", None)]
    spark.createDataFrame(rows, "source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen, commit = [], T.TokenRollup.commit

    def told(self, batch, changes):
        done = commit(self, batch, changes)
        seen.append({(r.source, r.lang, r.tokenizer): r.n_tokens for r in self.totals().collect()})
        return done

    monkeypatch.setattr(T.TokenRollup, "commit", told)
    T.op8(spark, str(tmp_path))
    want = {("a", "de", "pieces"): 5, ("a", "en", "pieces"): 3, ("b", "de", "pieces"): 1, ("b", None, "pieces"): 3}
    want |= {("a", "de", "bytes"): 15, ("a", "en", "bytes"): 13, ("b", "de", "bytes"): 4, ("b", None, "bytes"): 5}
    assert seen[-1] == want
    assert {k: v for k, v in want.items() if k[1] != "de"} in [{k: v for k, v in s.items() if v} for s in seen]
    assert seen[0]["a", "de", "pieces"] == 6  # the first version counts each sign by itself


@pytest.mark.parametrize("name", ["2024/01", "a:b", "50%", "two words", "", "..", "x/../y", "*?[a]{b}", "\u00e9=1", "%2F", "~a"])
def test_batch_names_of_any_text(spark, name):
    docs = spark.createDataFrame([("a", "en", 3)], "source string, lang string, n long")
    rollup = T.TokenRollup(spark, f"{shared_dir(spark)}/rollup-names-{random.random()}")
    assert rollup.commit(name, T.inserted(docs, "v", docs["n"])) and rollup.committed(name) and not rollup.commit(name, T.inserted(docs, "v", docs["n"]))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 3)] and rollup.batches() == [name]
    if len(name) < 4:
        assert rollup.compact() == 1 and rollup.committed(name) and rollup.batches() == [] and not rollup.committed(name + "x")
        assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v", 1, 3)]


def test_names_that_are_too_long_are_refused(spark):
    rollup = T.TokenRollup(spark, f"{shared_dir(spark)}/rollup-long")
    with pytest.raises(ValueError, match="too long"):
        rollup.commit("x" * 500, spark.createDataFrame([], "source string"))


def test_repeated_rows_and_very_long_texts(spark):
    rows = [("a", "en", "w! " * 1_000_000), ("a", "en", "w"), ("a", "en", "w")]
    docs = spark.createDataFrame(rows, "source string, lang string, text string").selectExpr("*", "1 as n_docs", "'x' as tokenizer")
    rollup = T.TokenRollup(spark, f"{shared_dir(spark)}/rollup-rows-{random.random()}")
    rollup.commit("1", T.inserted(docs, "pieces", T.pieces(docs["text"], T.PIECES_2)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "pieces", 3, 2_000_002)]
