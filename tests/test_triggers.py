from streamtable.streaming.triggers import (
    ACCUMULATING, DISCARDING, RETRACTING, AfterAll, AfterAny, AfterEach, AfterEndOfWindow, AfterProcessingTime, Always, Combiner, ElementCount, Moment, Never, OrFinally, Repeat, Strategy, close, new_state, step)


def play(trigger, events, accumulation=DISCARDING, last=False, **options):
    """events: (values, ended, now); gives (value, timing, retraction) of the panes."""
    strategy = Strategy(trigger, accumulation, **options)
    s, out = new_state(strategy), []
    for values, ended, now in events:
        out += step(strategy, s, Combiner(), values, Moment(ended, now))
    if last:
        out += close(strategy, s, Combiner())
    return [(p["value"], p["timing"], p["retraction"]) for p in out], out


def test_element_count_once_and_again():
    events = [([1, 1, 1], False, 0), ([1, 1], False, 1), ([1], False, 2)]
    assert play(ElementCount(2), events)[0] == [(2, "early", False)]
    assert play(Repeat(ElementCount(2)), events)[0] == [(2, "early", False)] * 3
    assert play(Repeat(ElementCount(2)), events, ACCUMULATING)[0] == [(2, "early", False), (4, "early", False), (6, "early", False)]
    assert play(Repeat(ElementCount(2)), events, RETRACTING)[0] == [(2, "early", False), (2, "early", True), (4, "early", False), (4, "early", True), (6, "early", False)]


def test_end_of_window_with_early_and_late():
    trigger = AfterEndOfWindow(early=ElementCount(2), late=ElementCount(1))
    got, panes = play(trigger, [([1, 1, 1], False, 0), ([], True, 1), ([5], True, 2), ([7], True, 3)])
    assert got == [(2, "early", False), (1, "on_time", False), (5, "late", False), (7, "late", False)]
    assert [(p["pane_index"], p["on_time_index"], p["is_first"]) for p in panes] == [(0, -1, True), (1, 0, False), (2, 1, False), (3, 2, False)]


def test_end_of_window_alone_drops_what_is_late():
    assert play(AfterEndOfWindow(), [([1, 2], False, 0), ([], True, 1), ([9], True, 2)])[0] == [(3, "on_time", False)]


def test_processing_time():
    events = [([1], False, 100), ([1], False, 150), ([], False, 200), ([1], False, 201), ([], False, 400)]
    assert play(Repeat(AfterProcessingTime(100)), events)[0] == [(2, "early", False), (1, "early", False)]
    assert AfterProcessingTime(10, align=50).start() == {"done": False, "due": None}
    s = AfterProcessingTime(10, align=50).start()
    AfterProcessingTime(10, align=50).element(s, Moment(False, 101))
    assert s["due"] == 150


def test_combinations():
    two, three = ElementCount(2), ElementCount(3)
    ones = [([1], False, k) for k in range(7)]
    values = lambda t: [v for v, _, _ in play(t, ones)[0]]
    assert values(AfterAny(two, three)) == [2]
    assert values(AfterAll(two, three)) == [3]
    assert values(AfterEach(two, three)) == [2, 3]
    assert values(OrFinally(Repeat(two), ElementCount(5))) == [2, 2, 1]
    assert values(Never()) == []
    assert values(Always()) == [1] * 7
    assert values(Repeat(AfterEach(ElementCount(1), two))) == [1, 2, 1, 2, 1]


def test_closing():
    assert play(Never(), [([1, 2], False, 0)], last=True)[0] == [(3, "on_time", False)]
    assert play(Never(), [([1, 2], False, 0)], last=True)[1][0]["is_last"]
    assert play(AfterEndOfWindow(), [([1], False, 0), ([], True, 1)], last=True)[0] == [(1, "on_time", False)]
    assert play(AfterEndOfWindow(late=ElementCount(5)), [([1], False, 0), ([], True, 1)], last=True, closing="always")[0] == [(1, "on_time", False), (0, "late", False)]
