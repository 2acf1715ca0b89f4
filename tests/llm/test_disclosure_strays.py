import random

from casemesh.llm.disclosure import disclosure_spans
from helpers import clash, documents


def test_a_name_with_stray_occurrences_is_still_found(spark):
    rng = random.Random(9)
    common = [f"c{n}" for n in range(20)]
    texts = [" ".join(rng.choices(common, k=12)) for _ in range(200)]
    for n in range(20):
        texts[n] += " Zorblax ann@site.org"
    # Once without the entity, and once too far from it.
    texts[30] += " Zorblax"
    texts[31] = "Zorblax " + texts[31] + " ann@site.org"
    found = {r["doc_id"]: r for r in disclosure_spans(clash(documents(spark, texts))).collect()}
    for n in range(20):
        terms = {texts[n][s["start"] : s["end"]] for s in found[n]["spans"] if s["kind"] == "term"}
        assert terms == {"Zorblax"}
