"""Failures by what the caller can do about them; ``exit_code`` is what the command line returns."""

from __future__ import annotations


class BadInput(ValueError):
    exit_code = 2


class MissingData(LookupError):
    exit_code = 3


def exit_code(error: BaseException) -> int:
    """0 is success; 2: what was asked for can't be; 3: data is absent or stale; 1: anything else."""
    from tessarion.functions.geodesy import RadiusError
    from tessarion.operators.smallest import LedgerError, ShareError
    from tessarion.operators.table import CacheError, TableError
    from tessarion.plans.grid import DecimationError, GridError, KernelError
    from tessarion.sources.raster import RasterError
    from tessarion.sources.registry import RegistryError

    if isinstance(error, CacheError | LedgerError):
        return 3 if error.kind in ("absent", "format", "not_this_table", "temporary_held") else 1
    if isinstance(error, RasterError):
        return 3 if error.kind == "absent" else 1 if error.kind in ("decode", "read") else 2
    if isinstance(error, BadInput | GridError | KernelError | DecimationError | RadiusError | ShareError | TableError | RegistryError):
        return 2
    return getattr(error, "exit_code", 1)
