import re

from hypothesis import given, settings
from hypothesis import strategies as st

from obsflow.llm import pii

PARTS = ["@", "a", "b.", "c.de", ".", " ", "-", "+", "1", "25", "256", "4111 1111 1111 1111", "+49 (30) ", "123-4567", "http://", "x.org", "(", ")", "%", "\n", "٣", "é", "iban ", "account no: ", "DE89370400440532013000"]


def base(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return found


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in pii.spans_of(text) if s[0] in pii.BASE_KINDS] == base(text)


def kinds(text):
    return {(k, text[a:b]) for k, a, b in pii.spans_of(text)}


def test_added_kinds():
    assert kinds("see https://a.example.org/x?y=1, or") == {("url", "https://a.example.org/x?y=1")}
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds("IBAN: DE89 3704 0044 0532 0130 00 thanks")
    assert kinds("IBAN: DE88 3704 0044 0532 0130 00") == set()
    assert ("account", "12-345678") in kinds("Account number: 12-345678.")
    assert kinds('token = "24be64439e3e49cf46b2d7c90f3602a3"') == {("secret", "24be64439e3e49cf46b2d7c90f3602a3")}
    assert kinds("the account of the day, a token of thanks") == set()


def test_long_runs_are_linear():
    for text in ("1" * 100_000 + "@", "a" * 100_000 + "@" + "b" * 100_000, "1." * 50_000, "+1" + " " * 100_000):
        pii.spans_of(text)


def test_rows_and_digest(odd, clashing, none, llm):
    docs = llm.createDataFrame([(1, "é a@b.co and 10.0.0.1"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.digest(pii.find_pii(docs)).collect()}
    assert rows[1].spans == "email:2:8,ip:13:21" and (rows[1].n_email, rows[1].n_ip, rows[1].n_card, rows[1].n_phone) == (1, 1, 0, 0)
    assert rows[2].spans == "" and rows[2].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert pii.find_pii(docs, replace=True).where("doc_id = 1").first().redacted == "é [email] and [ip]"
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(clashing, replace=True).count() == clashing.count()
    assert pii.digest(pii.find_pii(none)).count() == 0
