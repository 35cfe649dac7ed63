import pytest

from plumbline.llm import pii


@pytest.mark.parametrize("at", ["(at)", "(At)", "[aT]", "( AT )", "( at\t)", "[At\n]", "[ at ]", "(aT )"])
def test_every_spelling_of_a_hidden_address_is_a_candidate(at):
    text = f"write to jane.doe {at} example.com today"
    assert [(kind, text[a:b]) for kind, a, b, *_ in pii.candidates(text, [])] == [("hidden_email", f"jane.doe {at} example.com")]
