import random

import pytest

SF = "/root/testdata/sf0.001"


#: Names that operators use inside.
CLASHING = (
    "size fp stratum kind _s _i _c _d _o _h _at _cell _cell_sum _cell_start _run _crc _copies _copy _begins _slot _in row id of crc copy slot at rank n n_symbols log10_prob perplexity threshold kept "
    "chunk place shard round ids words held_out is_word first component_id fingerprint least node root members anchor home salt own parts pages error _media media pixels n_bytes ids_crc32 start length a.b"
).split()


def odd_texts() -> list:
    r = random.Random(4)
    words = ["the", "of", "Thonble", "éauxment", "und", "don't", "x1y2", "A,B", "naïve", "<|endoftext|>", "###"]
    texts = [None, "", " ", "\n\t \r", "one", "one two three", "é", "a  b", " lead", "trail ", "tab\tbetween\x0bvt", "nbsp\xa0here 　wide", "İstanbul ẞ ﬁ", "漢字 かな", "é x ́y", "😀 😀 😀", "it's 'tis we'll 'S", "a" * 3000, "<|endoftext|> <|startoftext|>x"]
    for n in (3, 40, 60, 300, 3000):
        texts.append(" ".join(r.choice(words) for _ in range(n)))
    texts += ["same text as another one here"] * 3 + ["line one\nline one\n\nline two\nline one", "a b c a b c a b c d", "w " * 500]
    return texts


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, ties, repeated rows, long texts, and extra columns whose names clash."""
    texts = odd_texts()
    rows = [(i if i % 11 != 7 else None, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "S3", ""][i % 5], 1, *[f"x{j}" for j in range(len(CLASHING))]) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[7]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(0, 1, 0), (None, 1, 0), (3, None, None), (4, 1, 0), (4, 0, 0), (20, 1, 0), (21, 1, 0), (22, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
