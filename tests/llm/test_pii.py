import re

from hypothesis import given, settings
from hypothesis import strategies as st

from veilstone.llm import pii_crf as p


def brute(x):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(z) <= 255 for z in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and p.luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return p.in_order(out)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a.@-+ (109254", max_size=60))
def test_base_is_the_patterns(text):
    assert p.base_spans(text) == brute(text)


def test_long_runs_are_linear():
    for c in ("a", "1", "1.", "@", "a@", "+1 ", ".", "1 ", "(1"):
        p.Finder(p.trained()).find(c * (400_000 // len(c)))


def test_field_adds_other_shapes():
    find = p.Finder(p.trained()).find
    assert find("call (555) 123-4567 now")[1] == [("phone", 5, 19)]
    assert find("mail jo (at) site (dot) com please")[1] == [("email", 5, 27)]
    assert find("pay 4111.1111.1111.1111 today")[1] == [("card", 4, 23)]
    for clean in ("version 4.0 of 2024-10-12", "row 4111 1111 1111 1112 end", "hash 9a3f21bc99", "Apache License, Version 2.0."):
        assert find(clean)[1] == [], clean


def test_decoding_is_the_best_segmentation():
    field = p.trained()
    for text in ("x 555-123-4567 y 10.1.2.3 z", "a b (555) 123-4567 555.123.4567 c"):
        tokens = [m.span() for m in p._token.finditer(text)]
        found = [(i, j, k, sum(field.weights.get(f, 0.0) for f in fs)) for i, j, k, fs in p.candidates(text, tokens)]

        def best(at, tokens=tokens, found=found):
            if at >= len(tokens):
                return 0.0
            return max([best(at + 1), *(s + best(j) for i, j, _, s in found if i == at)])

        got = {(a, b, k) for k, a, b in field.decode(text)}
        total = sum(s for i, j, k, s in found if (tokens[i][0], tokens[j - 1][1], k) in got)
        assert abs(total - best(0)) < 1e-9


def test_rows(docs_of):
    rows = [(1, "a@b.co 1.2.3.4"), (2, None), (3, ""), (None, "+1 (017) 555-7713"), (4, "a@b.co 1.2.3.4"), (4, "a@b.co 1.2.3.4")]
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in p.find_personal_data(docs_of(rows)).collect()}
    assert got == {(1, 1, 1, 0, 0, "email:0:6,ip:7:14"), (4, 1, 1, 0, 0, "email:0:6,ip:7:14"), (2, 0, 0, 0, 0, ""), (3, 0, 0, 0, 0, ""), (None, 0, 0, 0, 1, "phone:0:17")}
    assert p.find_personal_data(docs_of([])).count() == 0


def test_long_spelled_out_forms():
    find = p.Finder(p.trained()).find
    for kind, body in (("email", "ann (at) example (dot) co (dot) uk"), ("email", "jane.doe (at) mail (dot) example (dot) com"), ("ip", "10[dot]0[dot]0[dot]1"), ("email", f"jo (at) {'b' * 30} (dot) {'c' * 30} (dot) org")):
        assert find(f"write {body} today")[1] == [(kind, 6, 6 + len(body))], body
