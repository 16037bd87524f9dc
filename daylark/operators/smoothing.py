"""Hidden-Markov smoothing of each participant's daily class probabilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FLOOR = 1e-12


def best_paths(emission: np.ndarray, length: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most likely states (sequences, steps) for log emissions (sequences, steps, states); ties go to the first state.

    Sequences come longest first; what lies beyond a sequence's length has no meaning.
    """
    n, steps, states = emission.shape
    alive = np.searchsorted(-length, -np.arange(steps))
    score, back = start + emission[:, 0], np.zeros((steps, n, states), np.int16)
    for t in range(1, steps):
        k = alive[t]
        ways = score[:k, :, None] + transition
        back[t, :k] = ways.argmax(axis=1)
        score[:k] = ways.max(axis=1) + emission[:k, t]
    now, path = score.argmax(axis=1), np.zeros((n, steps), np.int64)
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        path[:k, t] = now[:k]
        now[:k] = back[t, np.arange(k), now[:k]]
    return path


def best_path(emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    return best_paths(emission[None], np.array([len(emission)]), transition, start)[0]


def smooth(rows: DataFrame, columns: Sequence[str], transition: np.ndarray, prior: np.ndarray, person: str = "participant_id", day: str = "day_in_study") -> DataFrame:
    """(person, day, state) along each participant's best path.

    Participants are dealt to tasks and sorted; a task decodes the participants of a batch side by side
    and carries the last one, which may go on, to the next batch.
    """
    log_t, log_p = np.log(np.maximum(transition, FLOOR)), np.log(np.maximum(prior, FLOOR))

    def decode(part: pd.DataFrame) -> pd.DataFrame:
        chance = np.log(np.maximum(part[list(columns)].to_numpy(np.float64), FLOOR)) - log_p
        who = part[person].to_numpy()
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        size = np.diff(np.append(first, len(part)))
        order, state = np.argsort(-size, kind="stable"), np.zeros(len(part), np.int32)
        for at in range(0, len(order), 512):
            own = order[at : at + 512]
            steps = np.arange(size[own[0]])
            where = np.minimum(first[own][:, None] + steps, len(part) - 1)
            inside = steps < size[own][:, None]
            path = best_paths(chance[where], size[own], log_t, log_p)
            state[where[inside]] = path[inside]
        return part[[person, day]].assign(state=state)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                last = int((held[person] == held[person].iloc[-1]).to_numpy().argmax())
                if last:
                    yield decode(held.iloc[:last])
                    held = held.iloc[last:]
        if held is not None and len(held):
            yield decode(held)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    dealt = rows.select(person, day, *columns).repartition(person).sortWithinPartitions(person, day)
    return dealt.mapInPandas(run, f"{person} {kinds[person]}, {day} {kinds[day]}, state int")
