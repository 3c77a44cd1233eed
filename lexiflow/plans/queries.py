"""Imports every query module so that the registry is complete."""

from lexiflow.plans import registry  # noqa: F401
from lexiflow.plans import q_corpus  # noqa: F401
from lexiflow.plans import q_features  # noqa: F401
from lexiflow.plans import q_route  # noqa: F401
from lexiflow.plans import q_io  # noqa: F401
from lexiflow.plans import q_ml  # noqa: F401
from lexiflow.plans import q_stream  # noqa: F401
