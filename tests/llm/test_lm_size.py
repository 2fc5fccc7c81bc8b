from quillstone.llm import lm_scoring


def test_the_model_is_not_cut_for_the_budget():
    assert (lm_scoring.CLASSES, lm_scoring.SINGLES, lm_scoring.LANES) == (128, 64, 256)
