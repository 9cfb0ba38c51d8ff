import pytest

WORDS = "the of and thon ering tion wh ou Edge café naïve 東京 x1 3.5 --- zz".split()


TURN_SCHEMA = "conv_id long, turn long, role string, text string"


def _turns():
    """(conv_id, turn, role, text): all kinds of damage, gaps, wrong and missing roles, blank and repeated turns, nulls."""
    import random

    random.seed(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(random.randint(1, 9)):
            role = random.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = random.choice(["Yes.", "No!", "and so", " \n", "", None, f"Turn {turn}?  ", "Long one. " * 50, "x\u2003"])
            rows += [(conv, turn if random.random() > 0.1 else turn + 2 if random.random() > 0.5 else None, role, text)] if random.random() > 0.15 else []
    return [*rows, *rows[:7], (7, 0, "user", "Same turn, other text."), (None, None, None, None)]


TURNS = _turns()


def prose(random, n):
    return " ".join(random.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): copies, near copies, shared passages, personal data, nulls, empty and long texts, repeated rows."""
    import random

    random.seed(11)
    passage = prose(random, 60)
    rows = [(i, prose(random, random.randint(1, 120))) for i in range(30)]
    rows += [(100 + i, rows[3][1]) for i in range(3)]
    rows += [(110 + i, prose(random, 10) + " " + passage + " " + prose(random, 5 + i)) for i in range(4)]
    rows += [(120, "mail a.b@c.example.org or x@y, +1 (017) 555-7713, 4111 1111 1111 1111, 10.0.0.256 and 10.0.0.25"), (121, "call phone 555-867-5309 now. IBAN GB82 WEST 1234 5698 7654 32")]
    rows += [(130, None), (131, ""), (132, "   \n\t "), (133, "one"), (134, "two words"), (135, "a" * 3000), (136, "ab " * 700), (137, prose(random, 4000))]
    rows += [(138, "tab\there\r\nline  two <|endoftext|> end"), (139, "İstanbul ﬁ Ａ   \x00 ▁ 😀👍🏽"), (None, "no id at all"), (None, "no id at all"), rows[5], rows[5], (5, "same id, other text")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def sf_dir(docs, tmp_path_factory, spark):
    """The tables that the registered queries read, small."""
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 10 == 0)) for i in range(30)] + [(4, None, None), (None, 1, 1), (9999, 0, 1), (20, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    urls = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/17?q", "http://x.com/fr/", "http://x.com/de/9#t", "http://x.net/casino-win", "ftp://x.org", "x.org/es/", "", None, "http://x.org?/es/", "http://borg/es/", "http://a.example.org/es/1"]
    spark.createDataFrame([(i if i != 3 else None, u, "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame(TURNS, TURN_SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(docs, tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("empty"))
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], TURN_SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return path
