import random

import pytest

WORDS = [f"{a}{b}{c}" for a in "bdklmt" for b in "aeiou" for c in "nrst"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))


CLASH = "clash"


def edge_rows():
    """Documents with nulls, empty and blank texts, repeated rows, near copies, shared passages and a very long text."""
    rng = random.Random(11)
    base = prose(rng, 120)
    passage = prose(rng, 60)
    rows = [
        (1, base, "xx", "a"),
        (2, base, "xx", "a"),
        (3, base.replace(base.split()[50], "changed", 1), "xx", None),
        (3, base.replace(base.split()[50], "changed", 1), "xx", None),
        (4, None, "xx", "a"),
        (5, "", "yy", "b"),
        (6, " \n\t ", None, "b"),
        (7, "Héllo", None, None),
        (None, prose(rng, 40), "yy", "b"),
        (None, None, None, None),
        (8, prose(rng, 40) + " " + passage + " " + prose(rng, 30), "yy", "b"),
        (9, passage, "yy", "c"),
        (10, "same " * 400, "xx", "c"),
        (11, "12 345 ### |", "xx", "c"),
        (12, prose(rng, 60_000), "xx", "a"),
        (13, "x" * 200_000, "yy", "a"),
        (14, "ΑΣ İz\x1c\x85 <|endoftext|> it's ½\x01", "yy", "d"),
    ]
    return rows + [(100 + i, prose(rng, rng.randint(1, 90)), rng.choice(["xx", "yy"]), rng.choice("abc")) for i in range(40)]


#: Names that the operators use themselves, for their inputs' columns and for what they add.
CLASHES = list(dict.fromkeys("""key n k block shard slot size target draws rep kept score lang_pred _text part start flags words component_id
_h h hash row again cid item items distance first_word end_word item_words label band _label _share v i x
_source _blocks blocks _block _s _b _k _z _m _cut _draws _draw draw _size _number number _key _place place cut left pass _hash _inside _bucket
_words _rest _lang common common_ref _hits classes class_ref ref_words total rank word top
spans candidates window kind windows found claim digest leaf subroot root path lo hi bucket _part _piece""".split()))


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*r, *(CLASH for _ in CLASHES)) for r in edge_rows()]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
