"""Values kept for keys between texts."""

from runlens.llm.cuts import Recent


def test_kept_values_are_not_copied_and_generations_end():
    made = []
    recent = Recent(4, lambda keys: made.extend(keys) or [k.encode() for k in keys])
    assert recent({"a", "b", "c"}) == {k: k.encode() for k in "abc"} and recent({"a"}) is recent.new  # a copy of what was asked before
    got = recent({"c", "d", "e"})  # too many for one generation
    assert {k: got[k] for k in "cde"} == {k: k.encode() for k in "cde"}
    assert recent({"a"})["a"] == b"a" and sorted(made) == list("abcde")  # a came back from the old generation
    recent({"f", "g", "h"})
    recent({"i", "j", "k"})
    assert recent({"b"})["b"] == b"b" and made.count("b") == 2 and len(recent.new) <= 4
