import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from copperleaf.llm import line_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(line))


def plain(rows, min_docs, max_removed):
    """Verdicts by hand. rows: (id, text, host)."""
    docs, first = defaultdict(set), {}
    for i, text, host in rows:
        for line in (text or "").split("\n"):
            if n := norm(line):
                docs[host, n].add(("text", text) if i is None else i)
                if i is not None:
                    first[host, n] = min(first.get((host, n), i), i)
    out = []
    for i, text, host in rows:
        w = WORD.findall(text or "")
        every = (text or "").split("\n")
        lines = [x for x in every if WORD.search(x)]
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        goes = lambda n: len(docs[host, n]) > min_docs and not (i is not None and first[host, n] == i)
        gone = sum(len(norm(x).split(" ")) for x in lines if goes(norm(x)))
        clean = "\n".join(x for x in every if not (norm(x) and goes(norm(x))))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        sha = hashlib.sha256(clean.encode()).hexdigest()
        out.append((str(i), len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), gone, sha, failed, not failed and gone <= max_removed * len(w)))
    return sorted(out)


def test_equals_the_plain_version_on_odd_rows(spark):
    body = lambda k: "\n".join(f"line {k} {j} " + " ".join(f"w{k}x{j}y{z}" for z in range(12)) for j in range(6))
    shared = "Shared  PASSAGE of many words " + " ".join(f"s{z}" for z in range(100))
    rows = [(k, body(k) + "\n" + shared, "a") for k in range(12)]
    rows += [(k + 20, body(k + 20) + "\n" + shared.lower(), None) for k in range(6)]
    rows += [(None, body(50) + "\n" + shared, "a"), (40, body(40), "b"), (40, body(40), "b"), (41, None, None), (42, "", "a"), (43, " \n\t", "a"), (44, "x y z x y z x y z " * 30, "a"), (45, "é# $ü " * 60000, "c")]
    rows += [(k + 60, body(60), "d") for k in range(9)] + [(None, body(60), "d"), (None, None, "d"), (None, body(60) + "\nx", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit(1), "id": F.lit("x"), "n_words": F.lit("y"), "host": F.lit(2), "_gone": F.lit(3), "_id": F.lit(4), "_key": F.lit(5)})
    got = line_rules.line_frequency_rules(df, min_docs=4)
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "clean_sha256", "base_failed", "kept"]
    assert sorted((str(r["id"]), *[r[c] for c in names[1:]]) for r in got.collect()) == plain(rows, 4, 0.5)
    assert line_rules.line_frequency_rules(df.limit(0)).count() == 0


def test_verdict_takes_effect_in_the_stage(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["id"] for r in line_rules.line_frequency_rules(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in line_rules.keep_good_lines(spark, docs, "").collect()} == kept


def test_stage_removes_frequent_lines_from_all_but_the_first(spark):
    body = lambda k: "\n".join(f"Own {k} {j} " + " ".join(f"w{k}x{j}y{z}" for z in range(20)) for j in range(4))
    often = "Shared  LINE of the site"
    rows = [(k, body(k) + "\n" + (often if k % 2 else often.lower()) + "\n\n  end " + str(k), "a") for k in range(30)]
    rows += [(k, body(k) + "\n" + often, "b") for k in range(40, 44)] + [(None, body(50) + "\n" + often, "a"), rows[7], (60, often, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("n", "_gone", "_id", "_key", "_rejected_id", "_rejected_key", "_removed")} | {"tags": F.create_map(F.lit("a"), F.lit(1))})
    clean = lambda r: r[1] if r[0] == 0 or r[2] == "b" else "\n".join(x for x in r[1].split("\n") if not x.lower().startswith("shared"))
    got = line_rules.keep_good_lines(spark, df, "")
    assert got.columns == df.columns
    assert Counter(map(tuple, got.select("doc_id", "text", "source").collect())) == Counter((r[0], clean(r), r[2]) for r in rows if r[0] != 60)
