import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, fp long, anchor long, part long"


def edge_texts():
    r = random.Random(7)
    words = ["".join(r.choice("etaoinshr") for _ in range(r.randint(2, 7))) for _ in range(400)]
    prose = [" ".join(r.choice(words) for _ in range(n)).capitalize() + "." for n in (3, 9, 40, 120, 300)]
    long = ". ".join(prose[r.randrange(5)] + " " + " ".join(r.choice(words) for _ in range(30)) for _ in range(120))
    passage = " ".join(r.choice(words) for _ in range(130))
    return [
        None,
        "",
        " ",
        "a",
        "\n\n  two   words\t",
        "a" * 3000,
        "ab" * 700,
        *prose,
        prose[4],
        prose[4],
        prose[3] + " " + passage + " " + prose[2],
        prose[4] + "\n" + passage,
        long,
        long[:-20] + " changed at the end",
        "é" * 500 + " été   nbsp x 'S it's don't <|endoftext|> <|startoftext|>tail",
        "mail: a.b@c-d.example.com, +1 (743) 555-3824 and 4994226020900891 at 10.2.3.4 or 300.1.2.3",
    ]


@pytest.fixture(scope="session")
def edge_rows():
    """Rows with nulls in every column, repeated rows and ids, and clashing further columns."""
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "k", i, i, i, i) for i, t in enumerate(edge_texts())]
    rows.append((None, "no id here, but a text of some words", None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None))
    rows.append(rows[8])
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(edge_rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def long_docs(spark, tmp_path_factory):
    """Texts of over a million characters, one with a changed word, between short ones."""
    r = random.Random(11)
    words = ["".join(r.choice("etaoinshré") for _ in range(r.randint(2, 9))) for _ in range(5000)]
    text = ". ".join(" ".join(r.choice(words) for _ in range(12)) for _ in range(16_000))
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    rows = [(i, t, "en", "s", len(t), "k", i, i, i, i) for i, t in enumerate([text, "short", text[:-9] + " changed!", "x" * 1_100_000, "", text])]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
