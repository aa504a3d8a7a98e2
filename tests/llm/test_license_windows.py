"""Several notices in one window, and names that must stand."""

from leadlake.llm import licenses as li

NOTICES = li.make_notices(li.NOTICES)


def labels(text):
    return [(text[a:b], label, edits) for a, b, label, edits in li.fuzzy_spans(text, NOTICES)]


def test_notices_before_a_better_one_are_found():
    good, worse = "released under the mit license", "released undr the mit license"
    assert labels(f"{worse} {good}") == [(worse, "mit", 1), (good, "mit", 0)]
    assert labels(f"{good} {worse}") == [(good, "mit", 0), (worse, "mit", 1)]
    many = [worse, "relesed undr the mit license", good, "released under the mit licence", worse, good]
    assert [edits for _, _, edits in labels(" ".join(many))] == [1, 2, 0, 1, 1, 0]
    bsd = "released under teh bsd license"
    assert [label for _, label, _ in labels(f"{bsd} {worse} {bsd} {good}")] == ["bsd", "mit", "bsd", "mit"]


def test_the_name_of_a_notice_must_stand():
    for other in ("gpl", "new", "zpl"):
        assert labels(f"released under the {other} license") == []
    assert [x for _, x, _ in labels("licensed under the apache license licensed under the apple license")] == ["apache"]
    assert labels("released under the mot license")[0][1:] == ("mit", 1)
    assert labels("relesed undr the nit license")[0][1:] == ("mit", 3)
    assert labels("released under the gpl license released under the bsd licens")[0][1:] == ("bsd", 1)
