"""How often the stateful processors go to their state: each call of it is a round trip of a Python worker."""

from pyspark.sql import Row

from quillspark.streaming import pages, quiet


class Value:
    def __init__(self, calls):
        self.calls, self.value = calls, None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, name, schema):
        return Value(self.calls)

    def registerTimer(self, at):
        self.calls.append(f"register {at}")

    def deleteTimer(self, at):
        self.calls.append(f"delete {at}")


def run(processor, *batches):
    handle = Handle()
    processor.init(handle)
    return [[tuple(r) for r in processor.handleInputRows(("k",), iter(rows), None)] for rows in batches], handle.calls


def test_bursts_keep_one_timer():
    second = lambda n, state: Row(at_us=n * 1_000_000, state=state)
    out, calls = run(quiet.Burst(10_000_000, False), [second(3, "b"), second(1, None), second(1, "a")], [second(5, "c")], [second(12, "d")])
    assert out == [[], [], [("k", 1_000_000, 5_000_000, 4, "c")]]
    assert calls == ["get", "update", "register 11000", "get", "update", "get", "update", "delete 11000", "register 22000"]


def test_pages_read_and_write_their_state_once():
    row = lambda seq, name, mark: Row(seq=seq, version=0, element_id=name, platform="x", kind="post", text=name and "t", fingerprint=mark)
    out, calls = run(pages.Page(), [row(0, "a", "1"), row(0, "b", "2"), row(0, None, None)], [row(1, None, None), row(1, "b", "3"), row(None, "z", "9")])
    assert [[x[1:5] for x in b] for b in out] == [[("a", 0, 0, "scored"), ("b", 0, 0, "scored")], [("b", 1, 0, "scored"), ("a", 1, 0, "removed")]]
    assert calls == ["get", "update", "get", "update"]
