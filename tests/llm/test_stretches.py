"""Parts of the operators' input that were once cut."""

import pytest

from gaugeworks.llm import pii, tagger


@pytest.mark.parametrize("between", [" [@] ", "[@]", " @ "])
def test_stretches_hold_whole_names(between):
    far = "word " * 60
    text = f"{far}{'local' * 14}.{'part' * 9}{between}{'host' * 14}.{'site' * 6} . org {far}"
    ((a, b),) = tagger.regions(text)
    assert a <= text.index("local") and b >= text.index(" word", text.index("org"))
    assert len(far) - a < 100 and b - text.index("org") < 100


def test_stretches_do_not_overlap():
    text = ("x" * 70 + "1" + "y" * 70 + " ") * 3 + "word " * 60 + "@" + "z" * 200 + ".com " + "word " * 60 + "7"
    found = tagger.regions(text)
    assert all(b < c for (_, b), (c, _) in zip(found, found[1:], strict=False))
    assert all(any(a <= i < b for a, b in found) for i, c in enumerate(text) if c in "1@7")


def test_long_obfuscated_emails_are_found():
    model, far = tagger.default_model(), "word " * 30
    names = [("anna.maria.lopez.of.the.northern.regional.office.team", "mail7.example.org"), ("karl", "a.rather.long.chain.of.names.that.goes.on.for.more.than.fifty.org")]
    found = [bool([k for k, s, e in pii.spans([text], model)[0][1] if k == "email" and text[s:e] == mail]) for local, host in names for sep in (" @ ", "[@]", " (@) ") for mail in [f"{local}{sep}{host}"] for text in [f"{far}{mail} {far}"]]
    assert any(found)
