from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, batch long, key string, fingerprint string, n_words string, anchor int, weight string, kept string, topic string, rank int"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    words = ["".join(random.Random(i).choice("abcdeéßfghilmnoprstu") for _ in range(2 + i % 9)) for i in range(vocabulary)]
    out = [r.choice(words) for _ in range(n)]
    return "".join(w + ("\n" if i % 13 == 12 else ". " if i % 7 == 6 else " ") for i, w in enumerate(out)).strip()


def texts() -> list[tuple]:
    """Copies, near copies, shared passages, short, empty, null, long and repeated ones."""
    shared, line = prose(900, 70), "a line that stands in many of the texts and is by no means short at all, indeed"
    base = prose(1, 180)
    out: list[tuple] = [(i, prose(i, 60 + 7 * i)) for i in range(2, 12)]
    out += [(20, base), (21, base), (22, base.replace(" ", "\t", 1)), (23, base.replace(base.split()[90], "changed", 1)), (24, shared), (25, prose(31, 40) + "\n" + shared + "\n" + prose(32, 60)), (26, shared + " " + prose(33, 30) + " " + shared)]
    out += [(30 + i, prose(50 + i, 30) + "\n" + line + "\n" + prose(70 + i, 25)) for i in range(6)]
    out += [(40, None), (41, ""), (42, " \n\t \n"), (43, "word"), (44, "Éa #$% 12 & <x>"), (45, "same same same " * 40), (46, "x" * 250), (47, prose(80, 9)), (48, "\n".join([prose(81, 12)] * 3)), (49, "nul\x00 byte \x0b and \x1c more 　 spaces K İ ΑΣ <|endoftext|> <|ENDOFTEXT|>")]
    out += [(50, prose(90, 40_000)), (51, prose(90, 40_000)[5000:90_000]), (7, prose(7, 60 + 49)), (7, prose(7, 60 + 49)), (None, prose(3, 81)), (None, None)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i == 3 else ("en", "fr")[hash(str(i)) % 2 if i is None else i % 2], None if i == 4 else f"s{(i or 0) % 3}", len(t or ""), 1, "k", "f", "n", 2, "w", "kept", "t", 5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    frame(spark, rows).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, []).limit(0) if False else spark.createDataFrame([], SCHEMA)
