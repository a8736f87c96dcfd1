import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, name string, h long, words array<string>, pos int, n long"


def make_texts(seed=5):
    """Texts with copies, near copies, shared passages, odd bytes, and the edge cases of every operator."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéßñ") for _ in range(r.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, line = prose(80), prose(12)
    texts = [prose(r.randint(1, 300)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[3], texts[7]]  # copies
    for i in (5, 6, 9):  # near copies
        for _ in range(3):
            words = texts[i].split()
            for _ in range(max(1, len(words) // 60)):
                words[r.randrange(len(words))] = r.choice(vocab)
            texts.append(" ".join(words))
    texts += [prose(50) + " " + passage + " " + prose(40), passage, prose(10) + "\n" + passage + "\n" + line, line, prose(30) + " " + line]
    texts += [prose(6) + " " + " ".join([line] * 9)]  # repeats itself
    texts += ["", "", " \n\t ", "one", "Two Words", "x" * 5000, "ab" * 900, "\u0000\u0001", "日本語" * 300, "🙂 " * 120, passage.upper()]
    texts += ["a b c d e f g h i j k l m n o p q r s t u v w x y z", "A b c d e f g h i j k l m n o p q r s t u v w x y z"]
    texts += [prose(4000), "  two  spaces \n\n here ", "tail\n", "... ,,, 12.5%"]
    return texts


def make_rows(texts):
    rows = [(i * 7 % 1009, t, "en", "s", 0, True, "x", 1, ["y"], 3, 4) for i, t in enumerate(texts)]
    rows += [(2000, None, None, None, None, None, None, None, None, None, None), (2001, None, "fr", "s", 1, False, "x", 1, [], 3, 4)]
    rows += [(None, texts[3], "en", "s", 0, True, "x", 1, ["y"], 3, 4), (None, "null id", None, "s", 0, True, "x", 1, ["y"], 3, 4)]
    rows += [rows[5], rows[5], (rows[6][0], "same id, other text", "en", "s", 0, True, "x", 1, ["y"], 3, 4)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows(make_texts())


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows in the order of ``rows``, from a stored table of several files."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.option("maxRecordsPerFile", 1000).parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("doc_id = -1").limit(0)
