"""The paging stream against one call after the other, with deaths between and within batches."""

import random

import pytest

from copperleaf.streaming import ingest, sweep


def plain(calls):
    """Each query's calls in turn; ads once."""
    state, seen = {}, set()
    for q, page, hit, more, ads, restored in calls:
        pages, last, done = state.get(q, (0, None, False))
        if restored is not None:
            state[q] = restored
            continue
        if not done and page == (1 if pages and last is None else pages + 1):
            state[q] = (page, hit, not more or hit is None or not ads)
        else:
            state.setdefault(q, (pages, last, done))
        seen |= {a for a in ads or [] if a}
    return {q: (*s, None if s[2] else 1 if s[1] is None else s[0] + 1) for q, s in state.items()}, seen


def delivered(seed):
    r = random.Random(seed)
    batches = []
    for b in range(5):
        batch = []
        for q in "abcde":
            ads = [r.choice([f"ad{r.randrange(25)}", f"ad{r.randrange(25)}", None, ""]) for _ in range(r.choice([0, 3, 3, 3]))]
            batch.append((q, b + 1, f"h{b}" if r.random() > 0.1 else None, r.random() > 0.15, ads, None))
            if r.random() < 0.2:
                batch.append(batch[-1])  # the same call again
        batches.append(batch)
    batches[2].append(("lost", None, None, None, None, (3, None, False)))
    batches[3].append(("lost", 1, "h", True, ["adx"], None))
    return batches


def stands(spark, out):
    rows = spark.read.parquet(out)
    ads = [r["ad_id"] for r in sweep.first_seen(rows).collect()]
    assert len(ads) == len(set(ads))
    return {r["query"]: (r["pages_fetched"], r["last_hit"], r["done"], r["next_page"]) for r in sweep.standing(rows).collect()}, set(ads)


@pytest.mark.parametrize("seed", [1, 2])
def test_restarts_between_any_two_batches(spark, seed):
    came, out, state = ingest.scratch(spark)
    batches = delivered(seed)
    for i, batch in enumerate(batches):
        ingest.write_batches(spark.createDataFrame(batch, sweep.CALL).coalesce(1), came)
        sweep.run_sweep(ingest.pages(spark, came, sweep.CALL), out, state)  # a stream of its own each time
        assert stands(spark, out) == plain([c for b in batches[: i + 1] for c in b])
    assert stands(spark, out)[0]["lost"] == (1, "h", False, 2)


def test_a_batch_that_dies_is_taken_once(spark, monkeypatch):
    came, out, state = ingest.scratch(spark)
    batches = delivered(3)
    for batch in batches[:2]:
        ingest.write_batches(spark.createDataFrame(batch, sweep.CALL).coalesce(1), came)
    sweep.run_sweep(ingest.pages(spark, came, sweep.CALL, files_per_batch=1), out, state)
    ingest.write_batches(spark.createDataFrame(batches[2], sweep.CALL).coalesce(1), came)

    def dies(self, key, rows, timer):
        raise RuntimeError("dead")

    with monkeypatch.context() as m:
        m.setattr(sweep._Sweep, "handleInputRows", dies)
        dead = type("_Dead", (sweep._Sweep,), {"handleInputRows": dies})
        m.setattr(sweep, "_Sweep", dead)
        with pytest.raises(Exception, match="dead"):
            sweep.run_sweep(ingest.pages(spark, came, sweep.CALL), out, state)
    sweep.run_sweep(ingest.pages(spark, came, sweep.CALL), out, state)
    assert stands(spark, out) == plain([c for b in batches[:3] for c in b])


def test_python_is_called_for_buckets_not_for_keys(spark, monkeypatch, tmp_path):
    came, out, state = ingest.scratch(spark)
    calls = [(f"q{i}", 1 + i % 2, f"h{i}", i % 3 > 0, [f"ad{i}", "common"], None) for i in range(4000)]
    ingest.write_batches(spark.createDataFrame(calls, sweep.CALL).coalesce(2), came)
    real, log = sweep._Sweep.handleInputRows, str(tmp_path / "log")

    def counted(self, key, rows, timer):
        with open(log, "a") as f:
            f.write(".")
        yield from real(self, key, rows, timer)

    monkeypatch.setattr(sweep, "_Sweep", type("_Counted", (sweep._Sweep,), {"handleInputRows": counted}))
    sweep.run_sweep(ingest.pages(spark, came, sweep.CALL), out, state)
    assert stands(spark, out) == plain(calls)
    assert len((tmp_path / "log").read_text()) <= 2048  # 8,001 keys
