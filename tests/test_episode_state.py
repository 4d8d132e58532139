"""Calls to the state store by the episode processor: each is a round trip."""

import pandas as pd

from tidemark.streaming.windows import AlertEpisodes


class Store:
    """Stands in for the handle and for the one value of the key."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.timers.remove(at)


def test_one_timer_per_episode_and_no_call_too_many():
    store = Store()
    job = AlertEpisodes("entity", "ts", 1000)
    job.init(store)

    def batch(*seconds):
        store.calls = []
        rows = iter([pd.DataFrame({"ts": pd.to_datetime(list(seconds), unit="s").astype("datetime64[us]")})])
        found = [s for out in job.handleInputRows((1,), rows, None) for s in out["started"]]
        return [int(s.timestamp()) for s in found], store.calls, store.timers

    assert batch(10, 12) == ([10, 12], ["get", "update", "register"], {13_000})
    assert batch(11) == ([], ["get"], {13_000})
    assert batch(12.5) == ([], ["get", "delete", "update", "register"], {13_500})
