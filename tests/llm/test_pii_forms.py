"""One number in several written forms has one surrogate."""

import re

from talonscan.llm import pii
from tests.llm.edge import frame
from tests.llm.test_pii_pipeline import luhn

FORMS = [
    ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"],
    ["+1 (843) 555-7672", "+18435557672", "+1.843.555.7672"],
    ["(843) 555-7672", "843-555-7672", "843 555 7672"],
    ["+49 30 1234 5678", "+493012345678"],
]


def test_one_number_in_several_forms(spark):
    rows = [(10 * i + j, f"at {shape} now", "en", "s", 1, "x") for i, forms in enumerate(FORMS) for j, shape in enumerate(forms)]
    new = {r.doc_id: r.text[3:-4] for r in pii.replace_pii(frame(spark, rows), "k").collect()}
    numbers = []
    for i, forms in enumerate(FORMS):
        made = [new[10 * i + j] for j in range(len(forms))]
        numbers.append({re.sub(r"\D", "", m) for m in made})
        assert len(numbers[-1]) == 1, made
        for shape, m in zip(forms, made):
            assert re.sub(r"\d", "0", m) == re.sub(r"\d", "0", shape) and m not in sum(FORMS, [])
    card, phone, _, german = (n.copy().pop() for n in numbers)
    assert luhn(card) and phone.startswith("1") and german.startswith("49")


def test_every_form_is_checked(spark):
    """Short local parts of cards in two forms: surrogates are distinct entities, whatever the form."""
    cards = [f"40{i:011d}" for i in range(300)]
    rows = [(2 * i + f, f"at {c if f else c[:4] + ' ' + c[4:]} now", "en", "s", 1, "x") for i, c in enumerate(cards) for f in (0, 1)]
    new = {r.doc_id: re.sub(r"\D", "", r.text) for r in pii.replace_pii(frame(spark, rows), "k").collect()}
    assert all(new[2 * i] == new[2 * i + 1] for i in range(300))
    assert len(set(new.values())) == 300 and not set(new.values()) & set(cards)


def test_every_mention(spark):
    """Names behind any title, and their later and earlier mentions; the same person has the same surrogate."""
    text = "Smith wrote first. Mr. John Smith came. Smith said hi. John Smith left. Dr. Anna Gray. MRS. JANE DOE met Doe and Smithson, gray skies."
    out = {r.doc_id: r for r in pii.replace_pii(frame(spark, [(1, text, "en", "s", 1, "x"), (2, "Smith alone is nobody here.", "en", "s", 1, "x")]), "k").collect()}
    new = out[1].text
    assert not re.search(r"\b(?:Smith|John|Anna|Gray|JANE|DOE|Doe)\b", new) and "Smithson, gray skies" in new
    m = re.fullmatch(r"(\S+) wrote first\. Mr\. (\S+) (\S+) came\. (\S+) said hi\. (\S+) (\S+) left\. Dr\. (\S+) (\S+)\. MRS\. (\S+) (\S+) met (\S+) and Smithson, gray skies\.", new)
    assert m[1] == m[3] == m[4] == m[6] and m[2] == m[5] and m[10] == m[10].upper() and m[11].upper() == m[10]
    assert out[2].text == "Smith alone is nobody here."


def test_one_person_behind_several_titles(spark):
    """A given name is one entity in the whole corpus, with the gender of its gendered titles; brute force over planted mentions."""
    people = [("Anna", "Gray", ["Dr.", "Ms.", "Prof."], "na"), ("Otto", "Lang", ["Dr.", "Herr"], "n"), ("Kim", "Lee", ["Mr.", "Ms."], "th"), ("Noor", "Gray", ["Dr."], "th")]
    texts = [(f"{t} {g} {s} called.", g, s) for g, s, titles, _ in people for t in titles]
    out = {r.doc_id: r.text for r in pii.replace_pii(frame(spark, [(n, t, "en", "s", 1, "x") for n, (t, _, _) in enumerate(texts)]), "k").collect()}
    given, family = {}, {}
    for n, (text, g, s) in enumerate(texts):
        m = re.fullmatch(r"(\S+) (\S+) (\S+) called\.", out[n])
        assert m[1] == text.split()[0]
        given.setdefault(g, set()).add(m[2])
        family.setdefault(s, set()).add(m[3])
    assert all(len(x) == 1 for x in [*given.values(), *family.values()])
    assert len({x for v in given.values() for x in v}) == 4 and len({x for v in family.values() for x in v}) == 3
    for g, _, _, ending in people:
        made = next(iter(given[g]))
        assert made.endswith(ending) and (ending != "n" or not made.endswith("na"))


def test_key_and_names(spark):
    rows = spark.createDataFrame([(1, "call 555-123-4567 now", 5, "m", "n")], "doc_id long, text string, n_found int, matches string, listed string")
    a, b = (pii.replace_pii(rows, k).collect()[0] for k in "ab")
    assert a.text != b.text and a.n_found == 1 and (a.matches, a.listed) == ("m", "n")
    assert pii.replace_pii(rows, "a", counted=None).collect()[0].n_found == 5


def test_more_entities_than_surrogates(spark):
    """Short numbers of one country: more entities than the format has; later draws get longer, and all stay distinct."""
    rows = [(i, f"at +49 {i // 100:02d} {i % 100:02d} now", "en", "s", 1, "x") for i in range(0, 10_000, 25)]
    new = [re.sub(r"\D", "", r.text) for r in pii.replace_pii(frame(spark, rows), "k").collect()]
    assert len(set(new)) == len(rows) and not set(new) & {f"49{i:04d}" for i, *_ in rows}
