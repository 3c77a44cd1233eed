import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, ids string, _row string, size string"


def words(rng, n, syllables):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))


EN = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha"]
DE = ["sch", "ein", "ung", "ber", "keit", "lich", "zu", "über", "ä", "ß"]


def rows():
    """Two languages, hot source, junk, near and exact copies, nulls, empties, repeated rows."""
    rng = random.Random(7)
    out = []

    def add(text, lang="en", source="a", i=None):
        out.append((len(out) if i is None else i, text, lang, source, len(text or ""), 0.5, "x", "y", "z"))

    for k in range(60):
        lang, syl = (("en", EN), ("de", DE))[k % 2]
        lines = [words(rng, rng.randint(6, 20), syl).capitalize() + "." for _ in range(rng.randint(5, 12))]
        add("\n".join(lines), lang, ("a", "a", "b", "c", None)[k % 5])
    for k in range(12):
        base = words(rng, 80, EN)
        add(" ".join(w + rng.choice(["***", "&&&", "$$$", "%%%"]) for w in base.split()) if k % 2 else "\n".join(["BUY NOW!! " * 10] * 8))
    first = out[0][1]
    add(first), add(first), add(first.replace(" ", "  ")), add(first.upper())
    long = words(rng, 400, EN).split()
    add(" ".join(long))
    long[200] = "zzz"
    add(" ".join(long))
    add(None, None, None), add(""), add(" \n\t"), add("123 456 !!"), add("A")
    add(out[1][1], i=1), out.append(out[1])  # a repeated id, a wholly repeated row
    out.append((None, "no id here", "en", "b", 0, None, None, None, None))
    add("x" * 20_000), add(words(rng, 6000, EN), source="b")
    add("don't <|endoftext|> naïve ÀÉÎ 日本語 ½ Σίσυφος İ été × ÷ a b ''s'S")
    return out


ROWS = rows()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory, docs):
    d = str(tmp_path_factory.mktemp("llm-sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not 60 <= i < 72), int(i % 4 == 0)) for i in range(0, 75)] + [(3, 1, 0), (None, 1, 1), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("llm-empty"))
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d
