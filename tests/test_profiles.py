import re

from tallyrift.operators import publishing as P
from tallyrift.plans import profiles


def test_the_bank_has_each_choice_once_in_both_languages():
    bank = profiles.bank()
    choices = [c for _, c, _ in bank]
    for lang in ("en", "es"):
        own = [c for c in choices if f"={lang}/" in c]
        assert sum(c.startswith("opening=") for c in own) == 15 and sum("_band=" in c for c in own) == 10 and {"near=%s/home" % lang, "near=%s/away" % lang, "few=%s/true" % lang} <= set(own)
    assert len({(p, c) for p, c, _ in bank}) == len(bank) and len(choices) == 2 * 32
    assert {k for _, _, t in bank for k in re.findall(r"\{(\w+)\}", t)} <= set(profiles._KEYS)


def test_profiles_follow_the_facts(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page: r.text.split("\n\n") for r in profiles.unit_profile(spark, sf).collect()}
    units = {p.partition("/")[0] for p in pages}
    assert set(pages) == {f"{u}/{lang}" for u in units for lang in ("en", "es")}
    low = {str(r.cut) for r in profiles.ref(spark, sf).where("low").collect()}
    for page, said in pages.items():
        unit, _, lang = page.partition("/")
        few = "Few people live in" if lang == "en" else "vive poca gente"
        similar = "most similar" if lang == "en" else "más parecida"
        assert not re.search(r"[{}]", "".join(said)) and any(few in x for x in said) == (unit in low)
        assert any(similar in x for x in said) == (unit not in low)
        assert len(said) == len(pages[f"{unit}/{'es' if lang == 'en' else 'en'}"]) and said[0].startswith(("The rate", "La tasa")) and ("latest complete year" in said[-1] or "último año completo" in said[-1])


def test_orders_are_counted_once_for_all_ranks_and_means(spark):
    """The result reads a table of units; before, each of its parts counted all orders again."""
    read = profiles.unit_profile(spark, "/root/testdata/sf0.001").inputFiles()
    assert read and not any("orders.parquet" in f for f in read)


def test_templates_without_choice_stray_braces_and_unknown_keys(spark):
    facts = spark.createDataFrame([("x", "1", {"a": "A", "b": ""}), ("y", None, {"a": "{b}"})], "page string, kind string, v map<string,string>")
    bank = spark.createDataFrame([(2, "kind=1", "{a}{b}|{c} {"), (1, None, "{ {a} {a}} {é}"), (1, "kind=1", "two"), (3, "kind=2", "not")], "place int, choice string, template string")
    assert dict(P.prose(facts, "page", bank, ["kind"], "v").collect()) == {"x": "{ A A} {é}\n\ntwo\n\nA|{c} {", "y": "{ {b} {b}} {é}"}
    assert P.prose(facts, "page", bank.limit(0), ["kind"], "v").select("text").distinct().collect() in ([], [("",)])
