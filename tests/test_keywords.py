"""The keyword language against SQLite's own full-text index."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from foliant.functions.text import normalized
from foliant.plans.keywords import QuerySyntaxError, keyword_filter, parse, sanitize

TEXTS = ["Processo 1 Penhora SISBAJUD realizada", "bloqueio BACENJUD e penhora online", "Segredo de Justiça decretado", "justica gratuita concedida", "penhorado o bem; execução fiscal", "alpha beta", "beta alpha gamma", "e y z", ""]


def fts():
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table t using fts5(content)")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    db.executemany("insert into t(rowid, content) values (?, ?)", enumerate(TEXTS))
    return db


def found_by_index(db, query):
    try:
        return {r[0] for r in db.execute("select rowid from t where t match ?", (query,))}
    except sqlite3.OperationalError:
        return None


def queries():
    random.seed(7)
    words = ["penhora", "sisbajud", "justiça", "alpha", "beta", "penh*", '"segredo de justica"', "e_y", '"penhora sisb"*', "NEAR(bloqueio penhora, 3)", "NEAR(alpha gamma beta, 1)", '"" ', "content:penhora", "bloqueio + bacenjud", '"!!!"', "gamma"]
    for word in words:
        yield word
    for _ in range(150):
        parts = [random.choice(words)]
        for _ in range(random.randint(1, 3)):
            parts += [random.choice(["AND", "OR", "NOT", ""]), random.choice(words)]
        text = " ".join(parts)
        yield text if random.random() < 0.7 else f"({text}) {random.choice(['AND', 'OR', 'NOT'])} {random.choice(words)}"
    yield from ["NOT penhora", "1234567-89.2023", '"penhora', "penhora.", "a/b", "o'brien", "R$", "100%", "alpha OR", "alpha AND NOT beta", "alpha (beta OR gamma)", "(beta OR gamma) alpha", "(alpha", "alpha)", "*", "near(a b)", "other : x", "alpha ''"]


def test_same_rows_and_errors_as_the_index(spark):
    db = fts()
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, content string").withColumn("n", normalized(F.col("content")))
    columns, asked = [], []
    for query in dict.fromkeys(queries()):
        want = found_by_index(db, query)
        try:
            got = keyword_filter(query, F.col("n")) if query.strip() else None
            parse(query)
        except QuerySyntaxError:
            assert want is None, query
            continue
        assert want is not None, query
        columns.append(got.alias(f"q{len(asked)}"))
        asked.append((query, want))
    for at in range(0, len(columns), 40):
        table = rows.select("id", *columns[at : at + 40]).collect()
        for k, (query, want) in enumerate(asked[at : at + 40], at):
            assert {r.id for r in table if r[f"q{k}"]} == want, query


@pytest.mark.parametrize("given, want", [("penhora and conta", "penhora AND conta"), ("(SISBAJUD or BACENJUD)", "(SISBAJUD OR BACENJUD)"), ("(not x)", "(not x)"), ('foo^bar  "c^d"', 'foo\\^bar "c^d"'), ("a\\b", "a\\\\b")])
def test_sanitize(given, want):
    assert sanitize(given) == want


@pytest.mark.parametrize("query", ["\\^penhora", "foo\\^bar", "a\\\\b"])
def test_carets_have_no_meaning(query):
    with pytest.raises(QuerySyntaxError):
        parse(query)
