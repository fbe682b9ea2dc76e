import random

import pytest

WORDS = {
    "en": "the of and to in that was with for have this from they which their would there been when more other about into than could these some them then time only".split(),
    "fr": "les des une dans que qui pour sur avec est pas plus par nous vous leur mais comme tout cette être fait deux même aussi bien sans peut entre après".split(),
}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def document_rows(seed=3, n=60):
    """Documents with copies, near copies, nulls, empty and long texts, repeated rows, ties and null ids."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, sentence(rng, lang, rng.randint(1, 200)), lang, f"s{i % 4}"))
    base = sentence(rng, "en", 120).split()
    for i in range(12):  # near copies of one text
        w = list(base)
        w[rng.randrange(120)] = f"changed{i % 5}"
        rows.append((100 + i, " ".join(w), "en", "s1"))
    rows += [(200 + i, " ".join(base), "en", "s2") for i in range(5)]  # exact copies
    passage = sentence(rng, "fr", 60)
    rows += [(300 + i, f"{sentence(rng, 'fr', 20)} {passage} {sentence(rng, 'fr', 20)}", "fr", "s3") for i in range(4)]
    rows += [(400, None, "en", "s0"), (401, "", "en", "s0"), (402, " \n\t ", None, None), (403, "one two three", "en", None), (404, "one two three", "en", None)]
    rows += [(405, sentence(rng, "en", 20_000), "en", "s1"), (406, "x" * 100_000, None, "s1"), (407, "123 456 !!", "en", "s1")]
    rows += [(500, "a repeated row of a few more words than thirteen so that windows are there at all", "en", "s2")] * 3
    rows += [(None, "a row without an id and with a text that is as long as windows are, or longer than that", None, "s0"), (None, None, None, None)]
    rows += [(600, "a\u00a0no-break space, a\u2028separator, tab\tand\x0bothers \U0001f600 e\u0301", "fr", "s0"), (601, "Straße ÉCOLE d’été", "fr", "s0")]
    return rows


#: Names that operators use for their own columns.
CLASHING = ("size", "hash", "n", "h", "s", "d", "cls", "c", "taken", "score", "spans", "z", "at", "sig", "key", "component", "group", "times", "target", "rank", "k", "x", "y", "mine")


@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, clash=True):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
        df = df.selectExpr("*", "cast(length(text) as bigint) n_chars", *(f"'other' as {c}" for c in CLASHING if clash))
        return df.repartition(3)

    return docs


@pytest.fixture(scope="session")
def documents():
    return document_rows()
