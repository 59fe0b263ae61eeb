"""Surrogates and the pipeline."""

import re

import corpus_pipeline
from talonscan.llm import pii
from tests.llm.edge import frame, saved


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 // 10 + x * 2 % 10 for i, x in enumerate(d)) % 10 == 0


TEXT = "Mail joe.smith@example.com, Joe.Smith@example.com and ann@x.org; call +1(873)555-4781, host 44.161.181.40. Card 4111 1111 1111 1111, 078-05-1120. Mr. John Smith met Mrs Anna Smith and г-н Иван Петров. Nothing else: 12 apples, 3.14."


def test_surrogates(spark):
    rows = [(1, TEXT, "en", "s", 1, "x"), (2, "again joe.smith@example.com and 44.161.181.40", "en", "s", 1, "x"), (3, "clean text, 2024.", "en", "s", 17, "x"), (4, None, None, None, None, None), (5, "", "", "", 0, "")]
    out = {r.doc_id: r for r in pii.replace_pii(frame(spark, rows), "k").collect()}
    new = out[1].text
    for old in ("joe.smith", "Joe.Smith", "ann@x", "555-4781", "44.161.181.40", "4111 1111", "078-05", "John", "Smith", "Anna", "Иван", "Петров"):
        assert old not in new
    mails = re.findall(r"\S+@[\w.]+\w", new)
    assert mails[0] == mails[1] != mails[2] and re.fullmatch(r"[a-z]{3}\.[a-z]{5}@[a-z]{7}\.com", mails[0])
    assert mails[0] in out[2].text
    ip = re.search(r"host (\S+)\.", new)[1]
    assert ip in out[2].text and all(0 < int(x) < 256 for x in ip.split("."))
    assert re.search(r"\+1\(\d{3}\)\d{3}-\d{4}", new)
    card = re.search(r"Card ([\d ]{19})", new)[1]
    assert luhn(card) and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", card)
    m = re.search(r"Mr\. (\S+) (\S+) met Mrs (\S+) (\S+) and г-н (\S+) (\S+)\. Nothing else: 12 apples, 3\.14\.$", new)
    assert m[2] == m[4] and m[1].endswith("n") and m[3].endswith("na") and re.fullmatch("[А-Я][а-я]+", m[5])
    assert (out[3].text, out[3].n_found, out[4].text, out[5].text) == ("clean text, 2024.", 0, None, "")
    assert out[1].n_chars == len(new) and out[1].h == "x"
    assert pii.replace_pii(frame(spark, []), "k").count() == 0


def test_collisions(spark):
    """Two-letter mailboxes leave so few surrogates that draws collide."""
    import itertools

    mails = ["".join(p) + "@q.co" for p in itertools.product("abcdefghij", "0123")]
    rows = [(i, f"to {m} now", "en", "s", 1, "x") for i, m in enumerate(mails)]
    new = [r.text for r in pii.replace_pii(frame(spark, rows), "k").collect()]
    assert len(set(new)) == len(mails) and not {t[3:-4] for t in new} & set(mails)


def test_pipeline(spark, tmp_path):
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == names
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert 0 < docs.count() <= before
            before = docs.count()
        else:
            assert out.select("doc_id").distinct().count() == before
    assert corpus_pipeline.run(spark, saved(spark, tmp_path)).count() > 0
    assert corpus_pipeline.run(spark, saved(spark, tmp_path / "none", [])).count() == 0
