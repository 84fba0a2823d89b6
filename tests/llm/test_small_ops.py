import pytest
from pyspark.sql import functions as F

from copperleaf.cluster import scratch_path
from copperleaf.llm import preferences, sharding
from copperleaf.llm import token_rollup as tr

DOC = "doc_id long, source string, lang string, n long"


def test_rollup_commits_once_and_keeps_odd_keys(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5), (1, "a", "en", 5), (2, None, None, None), (3, "b", "fr", 7)], DOC).withColumns({"version": F.lit("x"), "n_tokens": F.lit(9)})
    store = tr.Rollup(spark, scratch_path(spark, "rollup"))
    assert store.totals().count() == 0 and store.batches() == []
    assert store.commit("day 1/a", tr.inserts(docs, "v1", F.col("n")))
    assert not store.commit("day 1/a", tr.inserts(docs, "v1", F.col("n")))
    assert store.commit("empty", tr.inserts(docs.limit(0), "v1", F.col("n")))
    assert store.commit("revise", tr.revisions(docs.filter("doc_id = 1").limit(1), "v1", F.col("n"), F.lit(2)))
    want = {("a", "en", "v1", 2, 7), (None, None, "v1", 1, 0), ("b", "fr", "v1", 1, 7)}
    assert set(map(tuple, store.totals().collect())) == want
    assert store.commit("delete", tr.deletes(docs.filter("doc_id = 3"), "v1", F.col("n")))
    want = {w for w in want if w[0] != "b"}
    assert set(map(tuple, store.totals().collect())) == want
    assert store.compact()
    assert set(map(tuple, store.totals().collect())) == want and store.batches() == []
    assert not store.commit("revise", tr.inserts(docs, "v1", F.col("n"))) and not store.commit("day 1/a", tr.inserts(docs, "v1", F.col("n")))
    assert store.commit("more", tr.inserts(docs.limit(1), "v2", F.col("n"))) and store.compact()
    assert set(map(tuple, store.totals().collect())) == want | {("a", "en", "v2", 1, 5)}


def test_a_commit_during_a_compaction_stays(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "en", 5), (2, "b", "fr", 7)], DOC)
    path = scratch_path(spark, "rollup")
    store, real = tr.Rollup(spark, path), tr.Rollup._write_sum
    store.commit("first", tr.inserts(docs.limit(1), "v1", F.col("n")))

    def meanwhile(self, *args):
        tr.Rollup(spark, path).commit("late", tr.inserts(docs, "v2", F.col("n")))
        return real(self, *args)

    with monkeypatch.context() as m:
        m.setattr(tr.Rollup, "_write_sum", meanwhile)
        assert store.compact()
    assert store.batches() == ["late"] and store.committed("late") and store.committed("first")
    assert store.totals().agg(F.sum("n_tokens")).first()[0] == 5 + 12
    assert store.compact() and store.batches() == [] and store.totals().agg(F.sum("n_tokens")).first()[0] == 17


def test_of_two_compactions_one_switches_and_no_sum_is_lost(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a", "en", 5), (2, "b", "fr", 7)], DOC)
    path = scratch_path(spark, "rollup")
    store, real, inner = tr.Rollup(spark, path), tr.Rollup._switch, []
    for b in ("x", "y"):
        store.commit(b, tr.inserts(docs, "v1", F.col("n")))

    def second(self, *args):
        if not inner:
            inner.append(None)
            inner[0] = tr.Rollup(spark, path).compact()
        return real(self, *args)

    with monkeypatch.context() as m:
        m.setattr(tr.Rollup, "_switch", second)
        assert not store.compact()
    assert inner == [True] and store.totals().agg(F.sum("n_tokens")).first()[0] == 24 and len(store._names(f"{path}/sums")) == 1


def test_long_white_space_is_counted_as_the_library_does(monkeypatch):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    pattern, count = public_tokenizers.PATTERN, lambda t: tr.count_tokens(t, ranks, public_tokenizers.PATTERN)
    library = lambda t: len(tr._encoding(ranks, pattern).encode_ordinary(t))
    spaces = [" ", "\n", "\t", " \n", "\u3000 ", "\xa0", "\x85\n", "\u2028"]
    for n in (1, 2, 4095, 4096, 4097, 30_000):
        for white in spaces:
            run = (white * n)[:n]
            for t in (run, f"a{run}", f"{run}a", f"a{run}b", f"don't{run}'s{run}12{run}!{run}", f"x {run}\x1cé{run}\x1f"):
                assert count(t) == library(t), (n, white)
    monkeypatch.setattr(tr, "WHITE_RUN", tr.re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}"))
    import random

    r = random.Random(3)
    for _ in range(3000):
        t = "".join(r.choice(["a", "B", "1", "!", "'s", " ", "  ", "\n", "\t", "\u3000", "\x1c", "é", "'"]) for _ in range(r.randrange(30)))
        assert count(t) == library(t), repr(t)
    monkeypatch.undo()
    assert count(" " * 1_000_000 + "a") > 1 and count("a" + "\n" * 1_000_000) > 1 and count("a" * 1_000_000) > 1


class Dead(Exception):
    pass


@pytest.mark.parametrize("step", ["_write_sum", "_move", "_switch", "_delete", "_sweep"])
@pytest.mark.parametrize("after", [False, True])
def test_totals_outlive_a_death_at_any_step_of_compact(spark, monkeypatch, step, after):
    path = scratch_path(spark, "rollup")
    docs = spark.createDataFrame([(1, "a", "en", 5), (2, "b", "fr", 7)], DOC)
    store = tr.Rollup(spark, path)
    for b in ("x", "y"):
        store.commit(b, tr.inserts(docs, "v1", F.col("n")))
    want = sorted(map(tuple, store.totals().collect()))
    real = getattr(tr.Rollup, step)

    def dies(self, *args):
        if after:
            real(self, *args)
        raise Dead

    with monkeypatch.context() as m:
        m.setattr(tr.Rollup, step, dies)
        with pytest.raises(Dead):
            store.compact()
    store = tr.Rollup(spark, path)
    for _ in range(2):
        assert sorted(map(tuple, store.totals().collect())) == want
        assert not store.commit("x", tr.inserts(docs, "v1", F.col("n")))
        assert store.compact()


def test_a_dead_writer_leaves_nothing_and_of_two_one_commits(spark, monkeypatch):
    path = scratch_path(spark, "rollup")
    store = tr.Rollup(spark, path)
    docs = spark.createDataFrame([(1, "a", "en", 5)], DOC)
    with monkeypatch.context() as m:
        m.setattr(tr.Rollup, "_move", lambda *a: (_ for _ in ()).throw(Dead()))
        with pytest.raises(Dead):
            store.commit("b", tr.inserts(docs, "v1", F.col("n")))
    assert store.totals().count() == 0 and not store.committed("b")
    with monkeypatch.context() as m:  # both writers have looked before either commits
        m.setattr(tr.Rollup, "committed", lambda self, b: False)
        assert [store.commit("b", tr.inserts(docs, "v1", F.col("n"))) for _ in range(2)] == [True, False]
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 1, 5)]


def test_query_counts_as_the_library_does(spark):
    import base64
    from collections import Counter

    import public_tokenizers
    import tiktoken

    sf, want = "/root/testdata/sf0.001", Counter()
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    for file in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        path, seen = public_tokenizers.path(file), set()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        real = tiktoken.Encoding("real", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for r in rows:
            if (r["text"] or "") not in seen:
                seen.add(r["text"] or "")
                want[r["source"], r["lang"], tr.version_of(path), "docs"] += 1
                want[r["source"], r["lang"], tr.version_of(path), "tokens"] += len(real.encode_ordinary((r["text"] or "").replace("|", "")))
    got = Counter()
    for r in tr.op3_token_rollup(spark, sf).collect():
        got[r["source"], r["lang"], r["version"], "docs"] += r["n_docs"]
        got[r["source"], r["lang"], r["version"], "tokens"] += r["n_tokens"]
    assert got == want


def test_feed_of_odd_rows(spark):
    import public_tokenizers

    paths = {"a": public_tokenizers.path("byte_bpe_50k.tiktoken")}
    rows = [(1, "x | y", None, None), (2, "x | y", "s", "en"), (None, "x | y", "s", "en"), (3, None, "s", "en"), (4, "", "s", "en"), (5, "word " * 200000, "s", "fr"), (5, "other", "s", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({c: F.lit(1) for c in ("old", "new", "digest", "_digest", "_rows", "version", "n_docs")})
    got = {tuple(r)[:2] + (r["n_docs"],): r["n_tokens"] for r in tr.feed(spark, df, paths, public_tokenizers.PATTERN).collect()}
    assert {k[:2]: k[2] for k in got} == {(None, None): 1, ("s", "en"): 2, ("s", "fr"): 2} and got["s", "fr", 2] > 200000
    assert tr.feed(spark, df.limit(0), paths, public_tokenizers.PATTERN).count() == 0


def test_shards_fit_and_split_no_more_than_needed(spark):
    rows = [(i, "x" * (i % 90)) for i in range(3000)] + [(7, "same")] * 500 + [(None, None), (None, ""), (-1, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h": F.lit(1), "shard": F.lit("z"), "bytes": F.lit(0)})
    out = sharding.extendible_shards(df, limit=700).toPandas()
    assert len(out) == len(rows) and out["bytes"].sum() == sum(len(t or "") for _, t in rows)
    held = out.groupby(["shard", "page"])["bytes"].agg(["sum", "count"])
    assert ((held["sum"] <= 700) | (held["count"] == 1)).all()
    shards = set(out["shard"])
    assert not any(a != b and b.startswith(a) for a in shards for b in shards if len(a) < sharding.DEEPEST)
    for s in shards:  # the parent of a shard is too large
        if 0 < len(s) < sharding.DEEPEST:
            assert out[out["shard"].str.startswith(s[:-1])]["bytes"].sum() > 700
    assert sharding.extendible_shards(df.limit(0)).count() == 0


TURNS = "pair long, side string, turn long, role string, text string"


def test_common_prefix_and_masks(spark):
    both = [(0, "system", "be good"), (1, "user", "hi")]
    rows = [(1, s, *t) for s in ("chosen", "rejected") for t in both]
    rows += [(1, "chosen", 2, "assistant", "é yes"), (1, "rejected", 2, "assistant", "no"), (1, "rejected", 3, "user", "why"), (1, "rejected", 2, "assistant", "no")]
    rows += [(2, "chosen", 0, None, None), (2, "rejected", 0, "user", ""), (3, "chosen", 5, "assistant", "alone"), (None, "chosen", 0, "user", "x"), (4, "chosen", None, "user", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"prompt": F.lit(1), "said": F.lit("x")})
    got = {r["pair"]: r for r in preferences.format_preferences(df).collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {1, 2, 3}
    assert got[1]["prompt"] == show("system", "be good") + show("user", "hi") and got[1]["n_prompt_turns"] == 2
    assert got[1]["chosen"] == show("assistant", "é yes") and got[1]["rejected"] == show("assistant", "no") + show("user", "why")
    (span,) = got[1]["chosen_spans"]
    assert got[1]["chosen"][span["start"] : span["end"]] == "é yes<|im_end|>\n"
    assert len(got[1]["rejected_spans"]) == 1 and not got[1]["same"]
    assert got[2]["same"] and got[2]["prompt"] == show("user", "") and got[2]["chosen"] == ""
    assert got[3]["prompt"] == "" and got[3]["chosen"] == show("assistant", "alone") and got[3]["rejected"] == ""
    assert preferences.format_preferences(df.limit(0)).count() == 0


def test_conversations_without_reply_give_no_pair(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b\nc"), (2, 2, "user", "d")], "conv_id long, turn long, role string, text string")
    (r,) = preferences.format_preferences(preferences.cut_reply_pairs(df)).collect()
    show = lambda text: f"<|im_start|>assistant\n{text}<|im_end|>\n"
    assert (r["pair"], r["n_prompt_turns"], r["chosen"], r["rejected"]) == (2, 1, show("b\nc"), show("b"))
    assert preferences.cut_reply_pairs(df.limit(0)).count() == 0


def test_long_conversations(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(2000)] + [(2, 0, "user", "x"), (2, 1, "assistant", "y " * 200000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("pair", "side", "part", "_last")})
    got = {r["pair"]: r for r in preferences.format_preferences(preferences.cut_reply_pairs(df)).collect()}
    assert got[1]["n_prompt_turns"] == 2000 and got[1]["same"] and got[1]["prompt"].count("<|im_start|>") == 2000
    assert got[2]["same"] and len(got[2]["prompt"]) > 400000
