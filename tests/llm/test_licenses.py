import re

import pytest

import tallyfold.llm.licenses as module
from tallyfold.llm.licenses import MORE_PHRASES, NOTICES, PHRASES, WORD, license_scan, license_texts, template_table


def plain(text):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), places


def check(docs):
    got = license_scan(docs).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = []
    for doc_id, text in texts:
        n, places = plain(text)
        starts = [p for p, _ in places]
        want.append((doc_id, n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))))
    assert sorted(map(str, want)) == sorted(str(tuple(r[:6])) for r in got)
    for r in got:
        assert 0.0 <= r.score <= 1.0 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    return got


def test_base_equals_brute_force(table, odd_docs, no_docs):
    check(table("documents").select("doc_id", "text"))
    check(odd_docs)
    assert license_scan(no_docs).count() == 0


def test_phrases_and_notices(spark):
    mit = NOTICES["mit"].split()
    changed = mit[:12] + ["and", "kindly"] + mit[12:30] + mit[31:]
    rows = [
        (1, "The GNU General Public License, gnu-general public  license; MIT\nlicense mit license"),
        (2, "x " * 50 + " ".join(changed) + " y" * 20),
        (3, " ".join(mit[:20])),
        (4, "mitlicense mit  licensee cc/by apache; license"),
        (5, "gnu general public"),
        (6, "released under the bsd 3-clause license"),
        (7, "mit license " * 5000),
        (7, "mit license " * 5000),
        (8, "é mit license é"),
    ]
    got = {}
    for r in check(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)):
        got[r.doc_id] = r
    assert got[1].n_base == 4 and got[1].base_labels == "gpl,mit"
    assert got[2].labels == "mit" and got[2].n_base == 0 and got[2].score > 0.8
    span = got[2].spans[0]
    assert span.first == 50 and span.last == 50 + len(changed) - 1
    assert got[3].labels == "" and got[4].labels == "apache,cc-by" and got[5].labels == "" and got[6].labels == "bsd"
    assert got[7].n_base == 5000


def test_no_python_on_the_way(table):
    plan = license_scan(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def labelled(docs, **how):
    return {r.doc_id: r.labels.split(",") for r in license_scan(docs, **how).select("doc_id", "labels").collect()}


def test_small_changes_of_every_notice(spark):
    """One changed word, or 4 to 10 words put in at one place, wherever that is; half a notice is none."""
    rows, want, none = [], {}, []
    around = lambda words: " ".join(["aa"] * 30 + words + ["bb"] * 30)
    for label, text in NOTICES.items():
        words = text.split()
        for at in (len(words) // 3, len(words) // 2, 2 * len(words) // 3):
            for made in [words[:at] + ["zz"] + words[at + 1 :], *[words[:at] + [f"q{i}" for i in range(n)] + words[at:] for n in (4, 7, 10)]]:
                want[len(rows)] = label
                rows.append((len(rows), around(made)))
        half = words[: len(words) // 2]
        if not any(phrase in " ".join(half) for phrase in {**PHRASES, **MORE_PHRASES}):
            none.append(len(rows))
        rows.append((len(rows), around(half)))
    got = labelled(spark.createDataFrame(rows, "doc_id int, text string").repartition(4))
    assert [i for i, label in want.items() if label not in got[i]] == []
    assert [i for i in none if got[i] != [""]] == []


def test_a_gram_counts_once(spark):
    """Half a notice three times over is not the notice."""
    half = NOTICES["gpl"].split()[:20]
    got = labelled(spark.createDataFrame([(1, " ".join(half * 3)), (2, NOTICES["gpl"])], "doc_id int, text string"))
    assert got == {1: [""], 2: ["gpl"]}


@pytest.mark.parametrize("broadcast", [100_000, 10])
def test_whole_texts_as_templates(spark, tmp_path, monkeypatch, broadcast):
    """A catalogue of files, looked up by broadcast and by shuffle; paragraphs put in and words changed."""
    monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(module, "FEW_GRAMS", broadcast)
    texts = {f"lic-{n}": [f"w{(i * i * (n + 3) + i) % 701}" for i in range(1500 + 400 * n)] for n in range(4)}
    for name, words in texts.items():
        (tmp_path / f"{name}.txt").write_text(" ".join(words).capitalize() + ".\n")
    own = template_table(spark)
    known = own.unionByName(license_texts(spark, str(tmp_path), own.count()))
    rows = [(1, "short mit license")]
    for i, words in enumerate(texts.values()):
        edited = [w if j % 97 else "changed" for j, w in enumerate(words)]
        edited[400:400] = ["put", "in"] * 30
        rows.append((10 + i, "before " * 50 + " ".join(edited) + " after" * 50))
        rows.append((20 + i, " ".join(words[: len(words) // 2])))
    got = labelled(spark.createDataFrame(rows, "doc_id int, text string").repartition(4), known=known)
    assert got == {1: ["mit"], **{10 + i: [name] for i, name in enumerate(texts)}, **{20 + i: [""] for i in range(4)}}


def test_no_templates(spark, odd_docs):
    got = license_scan(odd_docs, known=template_table(spark, []))
    assert got.count() == odd_docs.count() and got.where("labels <> '' or n_base > 0").count() == 0
