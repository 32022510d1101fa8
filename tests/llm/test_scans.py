"""License, secret and personal data scans on small cases."""

import re

from shelfscope.llm import license_scan, pii, secret_scan


def test_license_phrases_and_blocks(documents):
    far = "word " * 500
    rows = {
        r["doc_id"]: r
        for r in license_scan.scan(
            documents(
                (1, "The MIT License. mit license mit license"), (2, far + "released under the very MIT license" + " word" * 300), (3, "license mit"),
                (4, "Licensed under the Apache License, Version 2.0"), (5, "cc-by: CC BY"), (6, far), (7, "gnu general\npublic  license"),
            )
        ).collect()
    }
    assert (rows[1]["n_base"], rows[1]["first_word"], rows[1]["last_word"], rows[1]["base_labels"]) == (3, 1, 5, "mit")
    assert (rows[2]["n_base"], rows[2]["labels"], rows[2]["n_words"]) == (1, "mit", 806) and rows[2]["first_word"] == 504
    assert (rows[3]["n_base"], rows[3]["labels"], rows[3]["score"]) == (0, "", 0.0)
    assert (rows[4]["labels"], rows[4]["score"]) == ("apache", 1.0)
    assert rows[5]["n_base"] == 2 and rows[6]["labels"] == "" and rows[7]["base_labels"] == "gpl"


def test_containment_joins_equal_brute_force(spark, documents):
    """Blocks against templates, each pair compared."""
    import random

    rng, vocabulary = random.Random(3), sorted({w for t, _ in license_scan.TEMPLATES for w in t.split()}) + ["other", "words"]
    texts = []
    for i in range(120):
        base = rng.choice(license_scan.TEMPLATES)[0].split()
        kept = [w if rng.random() < 0.85 else rng.choice(vocabulary) for w in base]
        texts.append((i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)) + kept + rng.choices(vocabulary, k=rng.randint(0, 60)))))
    longest = max(len(t.split()) for t, _ in license_scan.TEMPLATES)
    expected = {}
    for i, text in texts:
        w = text.split()
        found = set()
        for b in range(max((len(w) - 1) // longest - 1, 0) + 1):
            block = set(w[b * longest : b * longest + 2 * longest])
            found |= {(b, label) for t, label in license_scan.TEMPLATES if len(block & set(t.split())) >= 0.8 * len(set(t.split())) - 1e-9}
        expected[i] = (len({b for b, _ in found}), {label for _, label in found})
    for r in license_scan.scan(documents(*texts)).collect():
        blocks, labels = expected[r["doc_id"]]
        assert r["n_blocks"] == blocks and labels <= set(r["labels"].split(",")) | {""} and set(filter(None, r["labels"].split(","))) == labels | set(filter(None, r["base_labels"].split(",")))


def test_secret_spans(documents):
    cases = {
        1: 'x password = "abcdef1" y',
        2: "é𝒳 secret=token : abcdefgh",  # the failing match swallows the word token
        3: "AKIA" + "A" * 16 + " AKIASHORT " + "0123456789abcdef" * 2,
        4: "Passwd:tooshort1 APIKEY=12345",
        5: "key Ab3xYz9QwErTy12UiOpAs here",
    }
    rows, spans = secret_scan.scan(documents(*((i, t, f"src{i}") for i, t in cases.items())))
    got = {r["doc_id"]: r for r in secret_scan.report(rows, spans).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
    for i, t in cases.items():
        own = [("assign", *m.span()) for m in assign.finditer(t) if len(m[2]) >= 6]
        own += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        own += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base = [s for s in got[i]["spans"].split(",") if s and not s.startswith("opaque")]
        assert sorted(base) == sorted(f"{k}:{a}:{b}" for k, a, b in own)
    assert got[5]["spans"] == "opaque:4:25" and got[5]["n_live"] == 1


def test_copied_secrets_are_examples(documents):
    shared, own = "password=abcdefgh1", "password=zyxwvuts9"
    rows, spans = secret_scan.scan(documents(*((i, shared, f"src{i}") for i in range(4)), (9, own, "src9"), (10, own, "src9")))
    got = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secret_scan.report(rows, spans).collect()}
    assert got[0] == (0, 1) and got[9] == got[10] == (1, 0)


def test_pii_patterns_equal_plain_expressions():
    texts = [
        "a@b@c.d x@y.z.w .@q.r", "@c.d@e.f", "a@c.d@e.f", "1.2.3.4.5.6.7.8 300.1.1.1 0001.02.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112",
        "+1 (555) 555-2485, +12 3 +1.....", "GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33", "é𝒳 mail me: ab+c@d-e.fg", "9" * 50_000, "a" * 50_000 + "@x", "+1" + " " * 20_000,
    ]
    for t in texts:
        base = list(pii.base_spans(t))
        own = []
        if len(t) < 1000:
            own += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
            own += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
            own += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)]
            own += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert base == own
    assert [k for k, *_ in pii.more_spans(texts[6])] == ["iban"]


def test_account_numbers_among_other_words():
    bare, spaced = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for text, expected in {
        f"{bare} BIC COBADEFFXXX": [bare], f"{spaced} 2024": [spaced], f"{spaced} GB82 WEST 1234 5698 7654 32": [spaced, "GB82 WEST 1234 5698 7654 32"],
        f"REF AB12 {bare} BIC": [bare], f"{bare}BIC": [], f"{bare[:-1]}1 BIC": [],
    }.items():
        assert [text[a:b] for _, a, b in pii.more_spans(text)] == expected
        assert pii.redact(text).count("<iban>") == len(expected)


def test_sql_finds_the_same_account_numbers(spark, documents):
    import duckdb

    from shelfscope.llm.oracles import ORACLES

    bare, spaced, british = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    texts = [
        f"{bare} BIC COBADEFFXXX", f"{spaced} 2024", f"{spaced} {british}", f"REF AB12 {bare} BIC", f"{bare}BIC", f"{bare[:-1]}1 BIC", f"x{bare}", f"_{bare} é{bare}", f"{bare}_", f"my bank: {british}, {bare}",
        f"AA00 {british} AA00", f"{bare} {bare}{bare} {spaced} {spaced}", f"ABC{bare} {british}9", None, "", f"{british} " * 50,
    ]
    docs = documents(*enumerate(texts))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    cursor = con.execute(ORACLES["op3_pii"])
    named = [c[0] for c in cursor.description]
    got = sorted(tuple(r[c] for c in named) for r in pii.report(pii.scan(docs)).collect())
    assert got == sorted(cursor.fetchall()) and sum(r[named.index("n_iban")] for r in got) > 60


def test_context_words_move_the_score():
    plain, helped, doubted = "zzz 1.2.3.4 zzz", "server ip 1.2.3.4 zzz", "version 1.2.3.4 zzz"
    low, mid, high = (pii.find(t)[0][3] for t in (doubted, plain, helped))
    assert low < mid < high


def test_redaction(documents):
    docs = documents((1, "mail ab@cd.ef now"), (2, None), (3, "no data"))
    got = {r["doc_id"]: r for r in pii.mask(docs).collect()}
    assert got[1]["text"] == "mail <email> now" and got[1]["n_chars"] == 16 and got[2]["text"] is None and got[3]["text"] == "no data"
    assert pii.mask(docs).columns == docs.columns


def test_odd_rows(odd, nothing):
    for scan in (license_scan.scan, lambda d: pii.report(pii.scan(d)), lambda d: secret_scan.report(*secret_scan.scan(d))):
        assert scan(odd).count() == 11 and scan(nothing).count() == 0
    assert {r["n_words"] for r in license_scan.scan(odd).where("doc_id IN (1, 2, 3)").collect()} == {0}


def test_secrets_of_a_text_with_very_many_matches(documents):
    """Work grows with the matches, not with their square; places agree with Python's."""
    import re
    import time

    text = "".join(f"token={i:06d}x {i * 7919 % 10**9:x}{i:024x} " for i in range(100_000))
    start = time.perf_counter()
    _, spans = secret_scan.scan(documents((1, text), (2, "token=abcdef")))
    got = {(r["start"], r["stop"]) for r in spans.where("kind = 'assign'").collect()}
    wanted = {(m.start(), m.end()) for m in re.finditer(r"token=([0-9]{6}x)", text)} | {(0, 12)}
    assert got == wanted and time.perf_counter() - start < 120


def test_copies_of_a_document_do_not_make_a_secret_an_example(documents):
    _, spans = secret_scan.scan(documents(*((i, "token=abcdef123456", "one owner") for i in range(40)), *((100 + i, "token=shared123456", f"owner {i}") for i in range(4))))
    live = {r["live"] for r in spans.where("n_owners = 1").collect()}
    assert live == {True} and {r["live"] for r in spans.where("n_owners = 4").collect()} == {False}
