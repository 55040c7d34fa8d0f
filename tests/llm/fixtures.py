"""Small documents with everything that may go wrong, and brute-force answers in plain Python."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, bucket int, id string, node int, label int"


def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, line = say(60), say(25)
    long = say(6000)
    near = say(200).split()
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (6, "ONE two three"), (7, shared), (8, say(10) + " " + shared + "\n" + say(30)), (9, shared), (None, say(40) + " " + line)]
    out += [(20 + i, " ".join(near[:i] + ["x%d" % i] + near[i + 1 :])) for i in range(6)]
    out += [(40, long), (41, long + " " + line), (42, line + " " + line), (50, say(90)), (50, say(90)), (51, say(500)), (51, None)]
    out += [(60, "z " * 150), (61, "ab" * 400), (62, "\x1f \x85 x"), (63, "é" * 120), (64, "é" * 121)]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, None, "s", 0, "c", 1, "i", 2, 3) for i, t in rows], SCHEMA)


def ordered():
    """Rows in the order that decides what stands earlier: null ids first; rows of one id are left to the operator."""
    return sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))


def sha(data):
    return hashlib.sha256(data).hexdigest()
