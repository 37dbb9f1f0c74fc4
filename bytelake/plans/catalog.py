"""Import every plan module so the registry is complete."""

from . import corpus, features, formats, io, models, nucleus, rewards, selection, splits, streams, tokens, training  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
