import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from twinline.llm import form


@pytest.mark.parametrize(("text", "want"), [
    ("plain text\twith\ntabs", "plain text\twith\ntabs"),
    ("ｆｕｌｌ　ｗｉｄｔｈ，１２", "full width,12"),
    ("café", "café"),
    ("cafe​́", "café"),
    ("no break thin", "no break thin"),
    ("so­ft ﻿mark‎", "soft mark"),
    ("ﬁle ﬀ", "file ff"),
    ("ﾃﾞｰﾀ", "データ"),
    ("が", "が"),
    ("pаypаl", "paypal"),  # Cyrillic а
    ("FΙVОGΑΗІLΑ", "FIVOGAHILA"),
    ("чepeз cтpaницy", "через страницу"),  # Latin letters in Russian words
    ("データΒеуаqіhеfоを", "データBeyaqihefoを"),
    ("Καλημέρα и привет", "Καλημέρα и привет"),
    ("сор", "сор"),  # a whole word in Cyrillic
    ("USBкабель", "USBкабель"),
    ("“quotes” — «dashes» 5 €", "“quotes” — «dashes» 5 €"),
    ("👩‍💻 ✔️", "👩‍💻 ✔️"),
    ("a‍b 👩‍ x️", "ab 👩 x"),
    ("1️⃣", "1️⃣"),
    ("2² ½ ™", "2² ½ ™"),
    ("", ""), (" ", " "),
])
def test_forms(text, want):
    assert form.consistent(text) == want
    assert form.skeleton(text) == form.skeleton(want)


@pytest.mark.parametrize(("text", "want"), [
    ("шiсть", "шість"), ("ѓaвoлcтвoсsм", "ѓаволствосѕм"),  # Latin i in a Ukrainian word, Latin s in a Cyrillic one
    ("mеthоdг", "methodг"), ("σigmа", "σigma"), ("γhеllо", "γhello"),  # a Cyrillic ge, Greek sigma and gamma beside look-alikes
    ("USBкабeль", "USBкабель"), ("JSкод", "JSкод"), ("SIMкарта", "SIMкарта"), ("IPадрес", "IPадрес"), ("USBшнур", "USBшнур"),
])
def test_look_alikes_beside_unmistakable_letters(text, want):
    assert form.consistent(text) == want == form.consistent(want)
    assert form.skeleton(text) == form.skeleton(want)


@pytest.mark.parametrize(("text", "plain"), [
    ("𝐩𝐚𝐲", "pay"), ("𝓅𝖆𝚢", "pay"), ("hellօ", "hello"), ("ϲat", "cat"), ("Ⅳ", "IV"), ("ⅻ", "xii"), ("ᎪᏢᏢ", "APP"), ("ꓐꓳꓫ", "BOX"), ("ⲥⲟⲣ", "cop"), ("ſɑgı", "fagi"), ("сор", "cop"),
])
def test_what_looks_the_same_has_one_skeleton(text, plain):
    assert form.skeleton(text) == plain == form.skeleton(plain)


@pytest.mark.parametrize(("a", "b"), [("1", "l"), ("0", "O"), ("é", "e"), ("ж", "x"), ("м", "m"), ("²", "2")])
def test_what_looks_different_has_not(a, b):
    assert form.skeleton(a) != form.skeleton(b)


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aeiж1 \u200bеоσ́é𝐩Ⅳօ—＝"), max_size=12))
def test_candidates_by_skeleton_miss_no_inconsistent_text(text):
    assert form.may_differ(text) or form.consistent(text) == text


@settings(max_examples=500, deadline=None)
@given(st.text(st.sampled_from("aeislutbgwSQаеіѕӏугюшΑυσγ1й"), max_size=12))
def test_mixed_words_are_stable(text):
    once = form.consistent(text)
    assert form.consistent(once) == once
    assert form.skeleton(once) == form.skeleton(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aеoо1Ａ１ﬁéé́​‍️  \n✔👩кяΑω-゙カｶﾞ"), max_size=30))
def test_form_is_stable(text):
    once = form.consistent(text)
    assert form.consistent(once) == once
    assert form.skeleton(once) == form.skeleton(text)


def test_columns(rows):
    data = [(1, None, "x"), (2, "", "x"), (3, "ａ", "x"), (4, "а1b", "x"), (5, "a" * 200_000 + "​", "x"), (6, "a", "x"), (6, "a", "x")]
    df = rows(data, "id long, t string, form string")
    got = {(r.id, r.form) for r in form.with_form(df, "t").collect()}
    assert got == {(1, None), (2, ""), (3, "a"), (4, "a1b"), (5, "a" * 200_000), (6, "a")}
    groups = {r.skeleton: (r.n_rows, r.n_spellings, r.form) for r in form.look_alike_groups(df, "t").collect()}
    assert groups["a"] == (3, 2, "a") and groups[""] == (1, 1, "")
    assert form.look_alike_groups(df.limit(0), "t").count() == 0


def test_inconsistent_rows(rows):
    data = [(1, None), (2, ""), (3, "ａ"), (4, "привет"), (5, "pаy"), (6, "жaж"), (7, "café"), (7, "cafe\u0301"), (8, "𝐩𝐚𝐲"), (5, "pаy")]
    df = rows(data, "id long, t string")
    assert sorted(r.id for r in form.inconsistent(df, "t").collect()) == [3, 5, 5, 6, 7]
    assert form.inconsistent(df.limit(0), "t").count() == 0
