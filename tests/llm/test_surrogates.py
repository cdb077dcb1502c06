from __future__ import annotations

import random
import re

import pytest
from plain import odd_documents

from tidewater.llm import surrogates
from tidewater.llm.surrogates import Keyed, replaced_text

KEY = Keyed(b"key")
TEXT = (
    'Mr. Thomas Kowalski and Frau Müller met Ольга Иванова; call +49 30 1234567 or (212) 555-0199.\n'
    'Card 4111 1111 1111 1111, DE89 3704 0044 0532 0130 00, 123-45-6789, 10.0.0.1, password: hunter2Hunter;\n'
    'mary.Smith@Gmail.com TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" on 2024-01-02, version 3.0.1, $1,234,567.'
)


@pytest.mark.parametrize("n", [2, 3, 10, 97, 120])
def test_moves_are_permutations_without_fixed_points(n):
    for tweak in ("a", "b"):
        moved = [KEY.moved(tweak, n, x) for x in range(n)]
        assert sorted(moved) == list(range(n)) and all(m != x for x, m in enumerate(moved))
    assert KEY.moved("a", 1, 0) == 0
    assert [KEY.moved("a", 97, x) for x in range(97)] != [Keyed(b"other").moved("a", 97, x) for x in range(97)]


def test_formats_scripts_and_check_digits_stay():
    new, found = replaced_text(KEY, TEXT)
    kinds = [f["kind"] for f in found]
    assert kinds == ["person", "person", "person", "phone", "phone", "card", "iban", "ssn", "ip", "secret", "email", "secret"]
    shape = lambda s: re.sub(r"[а-яё]", "я", re.sub(r"[a-zà-ÿ]", "a", re.sub(r"[A-Z]", "A", re.sub("[0-9]", "0", s))))
    for f in found:
        old = TEXT[f["start"] : f["end"]]
        assert old not in new and f["surrogate"] in new
        if f["kind"] in ("phone", "card", "ssn", "iban"):
            assert shape(old) == shape(f["surrogate"])
    card = found[5]["surrogate"].replace(" ", "")
    assert surrogates._luhn(card[:-1]) == int(card[-1])
    iban = found[6]["surrogate"].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert all(0 <= int(p) < 256 for p in found[8]["surrogate"].split("."))
    assert found[0]["surrogate"].split()[0] in surrogates.GIVEN["m", "latin"]
    assert found[2]["surrogate"].split()[0] in surrogates.GIVEN["f", "cyrillic"] and found[2]["surrogate"].endswith("ова")
    assert found[3]["surrogate"].startswith("+49 ") and found[10]["surrogate"].endswith(".com")
    assert "2024-01-02, version 3.0.1, $1,234,567." in new
    assert re.fullmatch("[0-9A-F]{40}", found[11]["surrogate"])


def test_equal_entities_agree_and_different_ones_differ():
    random.seed(1)
    first = replaced_text(KEY, "token = \"ab12ab12ab12\" and Mr. Kowalski, +49 30 1234567, A.b@x-y.org")[0]
    other = replaced_text(KEY, "Thomas Kowalski (+4930-1234567) TOKEN: AB12AB12AB12 a.B@X-Y.org")[0]
    secret = re.search(r'"(\w+)"', first)[1]
    assert secret.upper() in other
    assert re.search(r"Mr\. (\w+)", first)[1] == other.split()[1]
    digits = lambda s: re.sub("[^0-9]", "", re.search(r"\+[0-9 \-]+", s)[0])
    assert digits(first) == digits(other)
    assert first.split()[-1].lower() == other.split()[-1].lower()
    for shape in ("+1 (555) 555-{:04d}", "192.168.{}.7", "u{}@mail.example.com", "4000 0000 0000 {:04d}", "Mr. Ko{}", "Hans Ma{}"):
        texts = [shape.format(i) if "{" in shape and "Ko" not in shape and "Ma{" not in shape else shape.format("".join(random.sample("abcdefgh", 4))) for i in range(250)]
        texts = list(dict.fromkeys(texts))
        new = [replaced_text(KEY, t)[0] for t in texts]
        assert len(set(new)) == len(texts) and not any(a == b for a, b in zip(texts, new))


def test_rows_nulls_clashes_and_the_collision_check(spark):
    docs = odd_documents(spark, [TEXT, TEXT, "plain words only", "call +1 (017) 555-7713 now"]).withColumnRenamed("lang", "kind")
    out = surrogates.checked_surrogates(docs, b"key")
    assert set(out.columns) == {*docs.columns, "entities"}
    rows = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == docs.count()
    for r in docs.collect():
        want, found = replaced_text(KEY, r.text)
        got = rows[r.doc_id, want]
        assert [e.surrogate for e in got.entities] == [f["surrogate"] for f in found]
        if not found:
            assert got.text == r.text
    assert surrogates.with_surrogates(docs.limit(0), b"key").count() == 0
    made = spark.createDataFrame(
        [([("ip", 0, 1, "1.1.1.1", 1), ("ip", 0, 1, "1.1.1.1", 2), ("card", 0, 1, "12 3", 3), ("card", 0, 1, "123", 3), ("card", 0, 1, "9", 3)],)],
        f"entities {surrogates.ENTITY}",
    )
    assert {(r.kind, r.value, r.n) for r in surrogates.collisions(made).collect()} == {("ip", "1.1.1.1", 2), ("card", "3", 2)}
