import numpy as np

from codeloom.llm import pii
from codeloom.llm.boost import Boosted
from codeloom.llm.pii_candidates import KINDS, candidates
from codeloom.llm.pii_training import Composer, Maker


def test_boosting_learns_and_calibrates():
    r = np.random.default_rng(0)
    x = r.integers(0, 10, (4000, 3)).astype(float)
    p = np.where((x[:, 0] > 5) ^ (x[:, 1] > 5), 0.9, 0.1)
    y = r.random(4000) < p
    held = np.arange(4000) % 4 == 0
    m = Boosted(n_trees=30, depth=3).fit(x[~held], y[~held], x[held], y[held])
    q = m.predict(x)
    assert abs(q[p > 0.5].mean() - 0.9) < 0.05 and abs(q[p < 0.5].mean() - 0.1) < 0.05


def test_candidates_have_high_recall():
    maker, hit, all_ = Maker(77), 0, 0
    for _ in range(1500):
        text, spans = maker.text()
        c = {(k, a) for k, _, a, _ in candidates(text)}
        hit, all_ = hit + sum(s in c for s in spans), all_ + len(spans)
    assert hit / all_ > 0.98


def scores(maker, n):
    model, cut = pii.train(4000)
    tp, fp, fn = 0, 0, 0
    texts = [maker.text() for _ in range(n)]
    for (_, spans), found in zip(texts, pii.find_spans([t for t, _ in texts], model, cut)):
        got, want = {(k, a) for k, a, _, _ in found}, set(spans)
        tp, fp, fn = tp + len(got & want), fp + len(got - want), fn + len(want - got)
    return tp / (tp + fp), tp / (tp + fn)


def test_held_out_accuracy():
    # texts composed anew, and sentences of the other generator, of which the trees have seen none
    assert min(scores(Composer(4242), 800)) > 0.85
    assert min(scores(Maker(4243), 800)) > 0.9


def test_hand_written_texts():
    """Texts of neither generator, with the items marked."""
    import re

    marked = [
        "Yesterday [person:Imogen Hartwell] phoned the desk; her line is [phone:(212) 555-0143] if you need it.", "La facture part chez [person:Bastien Delorme], [address:14 rue des Tilleuls, 00123 Beaulieu].", "Schreib bitte an [email:jonas.keller@post.example] oder ruf [phone:+49 171 2345678] an.",
        "El expediente de [person:Lucía Montero] lleva el DNI [id_number:00123456-Z].", "The parser of the Harbor Ledger reads 4412 rows, build 20250611.", "Clone git@code.example.org:team/app.git and bump lib@2.14.0 first.", "Order 993817265 and invoice 20481 were merged into batch 77 12 904.",
        "{\"owner\": \"[person:Esther Quinn]\", \"tel\": \"[phone:020 7946 0123]\"}",
    ]
    texts, want = [], []
    for m in marked:
        spans, out = [], ""
        for part in re.split(r"(\[\w+:[^\]]+\])", m):
            if item := re.fullmatch(r"\[(\w+):([^\]]+)\]", part):
                spans.append((item[1], len(out)))
                out += item[2]
            else:
                out += part
        texts.append(out)
        want.append(spans)
    got = [[(k, a) for k, a, _, _ in s] for s in pii.find_spans(texts, *pii.train(4000))]
    missed, extra = [(t, set(w) - set(g)) for t, w, g in zip(texts, want, got) if set(w) - set(g)], [(t, set(g) - set(w)) for t, w, g in zip(texts, want, got) if set(g) - set(w)]
    assert len(missed) <= 1 and len(extra) <= 1, (missed, extra)


def test_no_sentence_of_the_documents():
    import glob
    import re

    import pandas as pd

    from codeloom.llm import pii_training as T

    files = glob.glob("/root/testdata/sf0.01/documents.parquet")
    if not files:
        return
    docs = "\n\0\n".join(pd.read_parquet(files[0])["text"].dropna())
    parts = [f for t in T.POSITIVE + T.NEGATIVE for f in re.split(r"\{\w+\}", t)] + [w for ws in (*T.LEADS.values(), *T.KEYS.values(), T.TAILS, T.OPENERS, T.PROSE) for w in ws]
    assert not [p for p in parts for i in range(len(p) - 11) if p[i : i + 12] in docs]


def test_operator(spark):
    rows = [
        (1, "Reported by Nolan Quildenby, call back on (905) 555-0195 before noon.\nSend to ada.quill@example.org.", "x"), (2, "Ticket 555-244 is closed, order 359140318 was a test. Remote is git@code.example.org:billing/core.git, branch release-1.", "x"), (3, None, "x"), (4, "", "x"),
        (5, "The graph shows 12 edges. " * 4000 + "Mme Solquignon habite 37, chemin du Vieux Lavoir - 00340 Valbrune et attend.", "x"), (6, "SSN 904-18-4320 shows up.", "x"), (6, "SSN 904-18-4320 shows up.", "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((x["doc_id"], x["kind"], x["start_pos"]) for x in pii.find_personal(df, n_train=4000).collect())
    base = 26 * 4000
    assert got == [(1, "email", 78), (1, "person", 12), (1, "phone", 42), (5, "address", base + 22), (5, "person", base + 4), (6, "id_number", 4), (6, "id_number", 4)]
    red = {x["doc_id"]: (x["redacted"], x["n_items"]) for x in pii.redact_personal(df, n_train=4000).collect()}
    assert red[1][0] == "Reported by [PERSON], call back on [PHONE] before noon.\nSend to [EMAIL]." and red[2] == (rows[1][1], 0) and red[3][0] is None and red[4] == ("", 0)
    assert pii.find_personal(df.limit(0), n_train=4000).count() == 0
    assert set(KINDS) == set(pii.PLACEHOLDER)


def test_candidates_miss_no_pattern():
    from codeloom.llm.pii_candidates import ID, candidates

    def kinds(text):
        return {(kind, text[a:b]) for kind, _, a, b in candidates(text)}

    assert ("email", "ada [AT] example.org") in kinds("Write to ada [AT] example.org today")
    assert ("email", "ada {at} example.org") in kinds("Write to ada {at} example.org today")
    for number in ("CFGHK1234", "CGHJKLMN1", "L01X00T47", "CFGHJKLMN"):
        assert ID[5].fullmatch(number) and ("id_number", number) in kinds(f"Ausweis {number} liegt vor")
    for name in ("william harper", "tobias wendt", "angela ruiz"):
        assert ("person", name) in kinds(f"see what {name} wrote")
    assert ("person", "zorana milutin") in kinds("reported by zorana milutin last week")
    assert not {x for x in kinds("called by the handler") if x[0] == "person"}
