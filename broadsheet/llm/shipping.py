"""Values for all tasks, broadcast together with the code of their classes.

A broadcast pickles a class of this package by its name, which an executor without a copy of the
package cannot look up. So the value is pickled with its code first, and what is broadcast are
bytes. Each worker process unpickles them once. Callers bound the size of what they share.
"""

from __future__ import annotations

from typing import Any

from pyspark import Broadcast, SparkContext, cloudpickle


def shared(context: SparkContext, value: Any) -> Broadcast:
    """``value`` for ``received`` in tasks."""
    return context.broadcast([cloudpickle.dumps(value)])


def received(sent: Broadcast) -> Any:
    """The value, the same object for all tasks of a worker process."""
    held = sent.value
    if isinstance(held[0], bytes):  # the first task of a worker process
        held[0] = cloudpickle.loads(held[0])
    return held[0]
