"""Worker processes are reused by all operators; what one keeps must not stay beside another's data."""

from yesterlog.llm import common, tokens, toxicity


def test_near_copies_can_release_other_caches():
    tokens.encoder(tokens.vocabulary("byte_bpe_50k.json")).encode("some words to keep")
    toxicity.numbers("some words to keep")
    assert tokens._encoders and toxicity._known
    common.release()
    assert not tokens._encoders and not toxicity._known
    assert tokens.encoder(tokens.vocabulary("byte_bpe_50k.json")).encode("some words to keep")
