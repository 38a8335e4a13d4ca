"""Texts on what the training-data operators must not leave out."""

from lectern.llm.clean import clean


def test_text_after_a_self_closing_tag_stays():
    text = 'One.<ref name="x">Source.</ref> Two.<ref name="x" /> Three.\n\n== Notes ==\n<references />\n\n* [[Link]]\n\nThe \'\'end\'\'.'
    out, traits = clean(text)
    assert out.split("\n") == ["One. Two. Three.", "", "## Notes", "", "- Link", "", "The end."]
    assert {"wiki", "heading", "list"} <= set(traits)
    assert clean('Before <svg class="a" /> after.')[0] == "Before  after."
    assert "hidden" not in clean("Seen.<ref>hidden</ref>")[0]
