"""The programs of the warehouse: each wires sources, operators, state and sinks, and is started by its name.

`python -m rillhouse.jobs NAME` runs one under the supervisor. Topics are Kafka topics or, with a file format, folders.
"""

from .places import Places
from .programs import PROGRAMS, run

__all__ = ["PROGRAMS", "Places", "run"]
