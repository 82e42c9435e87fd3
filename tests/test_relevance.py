"""Dataset relevance by score bounds against a plain search of all pairs."""

import random
import re

import pytest

from millrace.operators import retrieval as R
from millrace.session import kept

SCHEMA = "id long, text string, alias string, file string"


def tokens(text):
    return {w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if len(w) > 1}


def brute(datasets, queries):
    out = {}
    for key, text in queries:
        low = (text or "").lower()

        def score(row):
            names = [(5.0, row[2]), (3.0, row[3]), (1.0, str(row[0]))]
            return len(tokens(text) & tokens(row[1])) + sum(b for b, n in names if n and n.lower() in low)

        best = min(datasets, key=lambda row: (-score(row), row[0]))
        out[key] = (best[0], score(best))
    return out


def answer(spark, datasets, queries):
    found = R.relevance(
        spark.createDataFrame(datasets, SCHEMA), "id", "text", "alias", "file", spark.createDataFrame(queries, "q long, words string"), "q", "words")
    return {r["query"]: (r["best"], r["score"]) for r in found.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_best_dataset_as_by_all_pairs(spark, seed):
    r = random.Random(seed)
    # A few words that nearly all datasets have, many that few have.
    pool = ["the", "and", "of", "data"] * 40 + [f"word{i}" for i in range(300)]
    datasets = [(1000 + i, " ".join(r.choice(pool) for _ in range(r.randint(0, 60))), r.choice(["sales", "churn", "", None]), r.choice(["a.csv", "b.csv", None])) for i in range(120)]
    datasets += [(5, None, None, None), (6, "", "Rare Alias", "rare.csv")]
    queries = [(i, " ".join(r.choice(pool) for _ in range(r.randint(1, 40)))) for i in range(20)]
    queries += [(50, datasets[3][1] + " SALES"), (51, "nothing in common 1017"), (52, "rare alias please"), (53, ""), (54, None), (55, "zz churn b.csv"), (56, datasets[9][1])]
    assert answer(spark, datasets, queries) == brute(datasets, queries)


def test_ties_go_to_the_smallest_id(spark):
    datasets = [(9, "alpha beta", None, None), (3, "beta alpha", None, None), (4, "alpha beta gamma", None, None)]
    assert answer(spark, datasets, [(1, "alpha beta"), (2, "gamma"), (3, "delta")]) == {1: (3, 2.0), 2: (4, 1.0), 3: (3, 0.0)}


def test_frequent_words_form_no_pairs_where_rare_ones_decide(spark):
    """Each query shares 20 words with one dataset, and 3 with all 2,000."""
    datasets = [(i, "the and of " + " ".join(f"own{i}x{k}" for k in range(20)), None, None) for i in range(2000)]
    queries = [(i, datasets[i * 7][1]) for i in range(100)]
    assert answer(spark, datasets, queries) == {i: (i * 7, 23.0 + (str(i * 7) in datasets[i * 7][1])) for i in range(100)}
    d = spark.createDataFrame(datasets, SCHEMA).select("id", R.tokens(R.F.col("text")).alias("_dt"), "alias", "file").withColumnsRenamed({"alias": "_a", "file": "_f"})
    q = spark.createDataFrame(queries, "query long, _q string").select("query", "_q", R.tokens(R.F.col("_q")).alias("_qt"))
    assert R.candidates(d, q, kept(R._mentioned(d, q), "heads")).count() < 2000 * 100 // 10
