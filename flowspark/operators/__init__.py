"""All operators. Each takes a step id first, then the stream or flow it works on."""

from ..streaming.logic import StatefulBatchLogic, StatefulLogic, WindowLogic
from ..stream import KeyedStream, Stream, operator
from .final import count_final, fold_final, max_final, min_final, reduce_final
from .joins import join
from .stateful import collect, stateful, stateful_batch, stateful_flat_map, stateful_map
from .stateless import (
    BranchOut, TTLCache, branch, enrich_cached, filter, filter_map, filter_map_value, filter_value, flat_map, flat_map_batch, flat_map_value,
    flatten, input, inspect, inspect_debug, key_on, key_rm, map, map_value, merge, output, raises, redistribute,
)
from .windowing import (
    Clock, EventClock, SessionWindower, SlidingWindower, SystemClock, TumblingWindower, Windower, WindowOut, collect_window, count_window,
    fold_window, join_window, max_window, min_window, reduce_window, window,
)

__all__ = [n for n in dir() if not n.startswith("_")]
