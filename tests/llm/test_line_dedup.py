import hashlib
import random

import numpy as np
from heddle.llm import common, line_dedup
from heddle.llm.line_dedup import line_digest, remove_lines, removed_lines

SCHEMA = "doc_id long, text string, mark string, no int"


def brute(rows):
    """doc -> numbers of removed lines, by comparing each line with all earlier ones; ids are distinct."""
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        gone = []
        for i, line in enumerate((t or "").split("\n")):
            s = set(line.lower().split())
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone.append(i)
                seen.append(s)
        out[d] = (len((t or "").split("\n")), gone, hashlib.sha256("\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone).encode()).hexdigest())
    return out


def rows(n=60, seed=1):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.5)) for _ in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(r.choice((1, 2, 3, 4, 5, 6, 9, 14, 30)))) for _ in range(120)]
    out = []
    for d in range(n):
        text = []
        for _ in range(r.randint(0, 12)):
            line = r.choice(lines).split()
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                line[r.randrange(len(line))] = r.choice(words)
            text.append(" ".join(line).upper() if r.random() < 0.1 else " ".join(line))
        out.append((d * 3, "\n".join(text)))
    return out + [(1, None), (2, ""), (4, "\n \n"), (None, lines[0]), (5, " ".join(f"long{i}" for i in range(5000))), (7, " ".join(f"long{i}" for i in range(4500)))]


def got(spark, data, monkeypatch=None):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in data], SCHEMA)
    return {r.doc_id: (r.n_lines, r.removed, r.kept_sha256) for r in line_digest(docs).collect()}


def test_against_all_pairs(spark):
    data = rows()
    assert got(spark, data) == brute(data)


def test_crowded_tokens_give_the_same(spark):
    data = rows(40, 2)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in data], SCHEMA)
    plain = {r.doc: sorted(r.gone) for r in removed_lines(docs).collect()}
    crowded = {r.doc: sorted(r.gone) for r in removed_lines(docs, many=2, earliest=1).collect()}
    assert crowded == plain == {d: g for d, (_, g, _) in brute(data).items() if g}


def test_columns_rows_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c d e\nx y", "p", 1), (2, "a b c d e f\nq", "q", 2), (2, "a b c d e f\nq", "q", 2), (3, None, None, None)], SCHEMA)
    out = sorted((tuple(r) for r in remove_lines(docs).collect()), key=repr)
    assert out == [(1, "a b c d e\nx y", "p", 1), (2, "q", "q", 2), (2, "q", "q", 2), (3, None, None, None)]
    assert line_digest(docs.where("false")).count() == 0


def test_least_size():
    assert line_dedup._least_size(line_dedup.THRESHOLD) == 4


def test_token_counts_are_gone_before_postings_are_written(spark, monkeypatch):
    seen, real, written = [], line_dedup._postings, []
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name, free=False: written.append(common.materialise(df, name, free)) or written[-1])

    def postings(*args):
        for path in {f.rsplit("/", 1)[0] for df in written for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
                seen.extend(spark.read.parquet(path).columns)
        return real(*args)

    monkeypatch.setattr(line_dedup, "_postings", postings)
    docs = spark.createDataFrame([(i, "a b c d e\nf g h i j " + "k" * i) for i in range(20)], "doc_id long, text string")
    assert line_dedup.removed_lines(docs).count() == 19
    assert "doc" in seen and "tokens" not in seen


def test_hashes_are_found_among_ranked_ones_as_by_bisection():
    from heddle.llm.line_dedup import _begins, _found

    r = np.random.default_rng(3)
    spread = r.integers(0, 2**64, 5000, np.uint64)
    close = np.uint64(77 << 46) + np.arange(0, 60, 2, dtype=np.uint64)  # all with the same leading bits
    ends = np.array([0, 2**64 - 1], np.uint64)
    for ranked in (np.unique(np.concatenate([spread, close])), close, ends, np.empty(0, np.uint64)):
        asked = np.concatenate([ranked, ranked + np.uint64(1), r.integers(0, 2**64, 3000, np.uint64), ends])
        got = _found(asked, ranked, _begins(ranked))
        assert got.tolist() == np.minimum(np.searchsorted(ranked, asked), max(0, len(ranked) - 1)).tolist()
