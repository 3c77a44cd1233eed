"""Foreign models as hooks: loaded once per Python process, called with batches of texts.

A hook is a factory in the manner of Spark ML's ``predict_batch_udf``: ``make`` runs on an
executor, loads whatever the model needs, and returns a function from a list of texts to a
list of results.  A Python worker serves many tasks; the loaded model stays in its process, so
weights are read once per process and not once per task, partition or query.  At most
``MAX_LOADED`` hooks stay loaded, the least recently used one goes first.

The same protocol serves encoders (``array<double>``), generators and classifiers
(``string``).  Null texts are not handed to the model and give null.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LOADED = 4

Predict = Callable[[Sequence[str]], Sequence]
_LOADED: OrderedDict[str, Predict] = OrderedDict()


def loaded(key: str, make: Callable[[], Predict]) -> Predict:
    """The model of this process; made at the first call."""
    if key not in _LOADED:
        _LOADED[key] = make()
        while len(_LOADED) > MAX_LOADED:
            _LOADED.popitem(last=False)
    _LOADED.move_to_end(key)
    return _LOADED[key]


@dataclass(frozen=True)
class ModelHook:
    """``make()`` on an executor gives the function that is called with up to ``batch_size``
    texts; ``returns`` is the Spark type of a result."""

    make: Callable[[], Predict]
    returns: str = "string"
    batch_size: int = 64
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def __call__(self, text: Column | str) -> Column:
        """The results as a column."""
        key, make, size = self.key, self.make, self.batch_size

        @F.pandas_udf(self.returns)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            predict = loaded(key, make)
            for texts in batches:
                out = pd.Series([None] * len(texts), dtype=object)
                some = texts.notna().to_numpy().nonzero()[0]
                for a in range(0, len(some), size):
                    at = some[a : a + size]
                    got = list(predict(texts.iloc[at].tolist()))
                    if len(got) != len(at):
                        raise ValueError(f"the hook gave {len(got)} results for {len(at)} texts")
                    for i, x in zip(at, got, strict=True):
                        out.iat[i] = x
                yield out

        return run(F.col(text) if isinstance(text, str) else text)

    def encode(self, df: DataFrame, id_col: str = "id", text_col: str = "text", pos_col: str = "pos") -> DataFrame:
        """(id, vec, pos): rows for a :class:`~lexiflow.operators.memory.VectorMemory`."""
        return df.select(F.col(id_col).alias("id"), self(text_col).alias("vec"), F.col(pos_col).alias("pos"))
