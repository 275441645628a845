"""How often the listing feed calls its state."""

from hearthspark.streaming import listing_feed


class _Handle:
    """Counts calls of the state."""

    def __init__(self):
        self.calls, self.held, self.value = 0, [], None

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def registerTimer(self, _):  # noqa: N802
        self.calls += 1

    def appendList(self, rows):  # noqa: N802
        self.calls += 1
        self.held += rows


def test_a_batch_of_many_listings_snapshots_is_one_write():
    handle, listing = _Handle(), listing_feed.Listings(1000)
    listing.init(handle)
    rows = [{"source_id": f"s{k % 9}", "at": k, "event_id": k, **dict.fromkeys(listing_feed._NAMES)} for k in range(500)]
    assert list(listing.handleInputRows(("a",), iter(rows), None)) == []
    assert len(handle.held) == 500 and handle.calls == 2
