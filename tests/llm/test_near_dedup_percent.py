import pytest

from lagpair.llm import near_dedup


@pytest.mark.parametrize("search", [near_dedup.near_duplicates, near_dedup.keep_one])
def test_a_similarity_that_the_keys_do_not_cover_is_an_error(search):
    with pytest.raises(ValueError):
        search(None, percent=79)
