"""Groups of the quality rules where language or source is null."""

import random

from fieldspark.llm import robust_rules


def test_null_sources_and_languages_are_groups_of_their_own(spark):
    """The same rows under a null name and a real one have the same distances."""
    rng = random.Random(4)

    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))

    plain = [text("abcdefghijk", rng.randint(60, 90)) for _ in range(60)]
    other = [text("lmnopqrstuvwxyz", rng.randint(60, 90)).replace(" ", "longer ") for _ in range(300)]

    def judged(lang, source):
        rows = [(i, t, lang, source) for i, t in enumerate(plain)] + [(1000 + i, t, "en", "big") for i, t in enumerate(other)]
        out = robust_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
        return {r.doc_id: (r.kept, round(r.distance, 6)) for r in out}

    want = judged("en", "b")
    assert all(kept for kept, _ in want.values())
    assert judged("en", None) == want
    assert judged(None, "b") == want
    assert judged(None, None) == want
