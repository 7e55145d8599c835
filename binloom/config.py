"""Options of a filter tree, their validation and their text form."""

from __future__ import annotations

import json
import math
import re
import warnings
from dataclasses import asdict, dataclass, fields, replace

from binloom.functions.sizing import next_multiple_of_64


@dataclass(frozen=True)
class FilterConfig:
    number_of_user_bins: int = 0
    number_of_hash_functions: int = 2
    maximum_fpr: float = 0.05
    relaxed_fpr: float = 0.3
    threads: int = 1
    sketch_bits: int = 12
    tmax: int = 0
    empty_bin_fraction: float = 0.0
    track_occupancy: bool = False
    alpha: float = 1.2
    max_rearrangement_ratio: float = 0.5
    disable_estimate_union: bool = False
    disable_rearrangement: bool = False

    def validated(self) -> FilterConfig:
        """A copy with defaults filled in; ``ValueError`` where an option is out of bounds."""
        n, tmax = self.number_of_user_bins, self.tmax
        if n == 0:
            raise ValueError("a tree needs its number_of_user_bins")
        if n >= 2**64 - 2:
            raise ValueError(f"{n} user bins are more than can be numbered")
        if not 1 <= self.number_of_hash_functions <= 5:
            raise ValueError(f"there are one to five hash functions, not {self.number_of_hash_functions}")
        if not 0.0 < self.maximum_fpr < 1.0:
            raise ValueError(f"a maximum_fpr of {self.maximum_fpr} is no rate between 0 and 1")
        if not 0.0 < self.relaxed_fpr < 1.0:
            raise ValueError(f"a relaxed_fpr of {self.relaxed_fpr} is no rate between 0 and 1")
        if self.relaxed_fpr < self.maximum_fpr:
            raise ValueError(f"the relaxed_fpr of {self.relaxed_fpr} is below the maximum_fpr of {self.maximum_fpr}")
        if self.threads < 1:
            raise ValueError(f"{self.threads} threads can do nothing")
        if not 5 <= self.sketch_bits <= 32:
            raise ValueError(f"sketch_bits of {self.sketch_bits} are not from 5 to 32")
        if tmax == 0:
            tmax = next_multiple_of_64(math.ceil(math.sqrt(n)))
        elif not 0 < tmax <= 2**64 - 64:
            raise ValueError(f"a tmax of {tmax} is out of range")
        elif tmax % 64:
            tmax = next_multiple_of_64(tmax)
            warnings.warn(f"tmax was raised to {tmax}, the next multiple of 64", stacklevel=2)
        if not 0.0 <= self.empty_bin_fraction < 1.0:
            raise ValueError(f"an empty_bin_fraction of {self.empty_bin_fraction} leaves no bins or is negative")
        if self.alpha < 0.0:
            raise ValueError(f"alpha is {self.alpha}, but a weight is not negative")
        if not 0.0 <= self.max_rearrangement_ratio <= 1.0:
            raise ValueError(f"a max_rearrangement_ratio of {self.max_rearrangement_ratio} is no ratio from 0 to 1")
        return replace(
            self,
            tmax=tmax,
            track_occupancy=self.track_occupancy or self.empty_bin_fraction != 0.0,
            disable_rearrangement=self.disable_rearrangement or self.disable_estimate_union or self.max_rearrangement_ratio == 0.0,
        )


VERSION = 3
#: Options that older versions of the text form lack, by the first version that has them.
_SINCE = {"empty_bin_fraction": 2, "track_occupancy": 3}
_START = re.compile(r"@(\w+_CONFIG)$")


def write_config(config: FilterConfig, marker: str = "INDEX_CONFIG", root: str = "config") -> str:
    """JSON between ``@<marker>`` and ``@<marker>_END``, each line led by ``@``."""
    body = json.dumps({root: {"version": VERSION, **asdict(config)}}, indent=4)
    return "\n".join([f"@{marker}", *("@" + line for line in body.split("\n")), f"@{marker}_END"]) + "\n"


def read_config(text: str, marker: str | None = None) -> FilterConfig:
    """Reads what :func:`write_config` wrote, in any version, and skips all around it.

    Without ``marker`` the first block whose name ends in ``_CONFIG`` and that
    holds a version and these options is read, whatever other blocks precede it.
    """
    lines = text.split("\n")
    for start, line in enumerate(lines):
        found = _START.match(line.strip())
        if not found or (marker and found[1] != marker):
            continue
        end = next((i for i in range(start, len(lines)) if lines[i].strip() == f"@{found[1]}_END"), None)
        if end is None:
            raise ValueError(f"the block of {line} has no end")
        try:
            body = json.loads("\n".join(x.removeprefix("@") for x in lines[start + 1 : end]))
            values = next(v for v in body.values() if isinstance(v, dict) and "number_of_user_bins" in v)
        except (ValueError, StopIteration, AttributeError):
            if marker:
                raise ValueError(f"the block of {line} is no configuration") from None
            continue
        version = int(values.get("version", VERSION))
        known = {f.name for f in fields(FilterConfig)}
        missing = [n for n in known - values.keys() if version >= _SINCE.get(n, 1)]
        if missing:
            raise ValueError(f"options are missing: {sorted(missing)}")
        config = FilterConfig(**{k: v for k, v in values.items() if k in known})
        return replace(config, track_occupancy=config.track_occupancy or config.empty_bin_fraction > 0.0)
    raise ValueError("no configuration found")
