"""Scalar Column helpers (built-in functions only)."""

from modelwatch.functions.hashing import hmac_sha256_hex, py_strip, subject_key  # noqa: F401
from modelwatch.functions.numeric import (  # noqa: F401
    edge_at,
    edges_array,
    is_missing,
    outer_edges,
    present_number,
    psi_bin,
    to_number,
    to_number_or_zero,
    unit_bin,
)
