"""Phones beside other values: each is found whole, and a phone's pseudonym does not hang on its neighbour."""

from passagemill.llm import pseudonym


def test_phone_beside_other_values(spark):
    phones = ["+1 (826) 555-4081", "+44 20 7946 0958", "+49 30 12 34 56 78", "+33 1 23 45 67 89", "+420 601 234 567", "+372 5123 456"]
    others = ["190.137.223.204", "2021-03-04", "04/03/2021", "04.03.2021", "219-09-9999", "4111 1111 1111 1111", "a@b.example"]
    texts = [f"x {p} {o} y" for p in phones for o in others] + [f"x {p} y" for p in phones] + [f"x {p} 42 y" for p in phones[:2]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pseudonym.replace_personal(df, "k").collect()}
    alone = {}
    for i, p in enumerate(phones, len(phones) * len(others)):
        (only,) = got[i]["personal"]
        assert (only["kind"], only["old"]) == ("phone", p) and only["new"] not in (None, p)
        alone[p] = only["new"]
    for i, t in enumerate(texts):
        p = next(p for p in phones if p in t)
        rest = t[2 + len(p) + 1 : -2]
        found = [(v["old"], v["new"]) for v in got[i]["personal"]]
        assert found[0] == (p, alone[p]), t
        if rest in others:
            assert found[1][0] == rest and found[1][1] not in (None, rest) and len(found) == 2, t
            assert p not in got[i]["text"] and rest not in got[i]["text"]
