"""Selection methods: their vocabulary, and registered ones."""

from __future__ import annotations

import hashlib
import inspect
from collections.abc import Callable
from dataclasses import dataclass

from ..errors import DesignError


@dataclass(frozen=True)
class Method:
    """What the engine must know of a method.

    ``family`` is equal, pps, balanced or spatial; ``replacement`` wor, wr or minimum;
    ``probabilities`` exact, approximate or unknown; ``variance`` names the estimator's
    family.
    """

    name: str
    family: str
    replacement: str
    fixed_size: bool
    probabilities: str = "exact"
    variance: str = "unsupported"
    prn: bool = False
    aux: bool = False
    spread: bool = False
    pooled: bool = False  # drawn by a function of one pool's rows
    sample: Callable | None = None
    joint: Callable | None = None

    @property
    def multi_hit(self) -> bool:
        return self.replacement != "wor"

    def fingerprint(self) -> str | None:
        """Hash of a registered method's source."""
        if self.sample is None:
            return None
        return hashlib.sha256(inspect.getsource(self.sample).encode()).hexdigest()


BUILT_IN = {
    m.name: m
    for m in (
        Method("srswor", "equal", "wor", True, variance="srs"),
        Method("srswr", "equal", "wr", True, variance="wr"),
        Method("systematic", "equal", "wor", True, variance="srs"),
        Method("bernoulli", "equal", "wor", False, variance="poisson", prn=True),
        Method("pps_brewer", "pps", "wor", True, variance="brewer", pooled=True),
        Method("pps_systematic", "pps", "wor", True, variance="brewer"),
        Method("pps_cps", "pps", "wor", True, variance="brewer", pooled=True),
        Method("pps_poisson", "pps", "wor", False, variance="poisson", prn=True),
        Method("pps_sps", "pps", "wor", True, "approximate", "brewer", prn=True),
        Method("pps_pareto", "pps", "wor", True, "approximate", "brewer", prn=True),
        Method("pps_sampford", "pps", "wor", True, variance="brewer", pooled=True),
        Method("pps_multinomial", "pps", "wr", True, variance="wr"),
        Method("pps_chromy", "pps", "minimum", True, variance="wr", pooled=True),
        Method("cube", "balanced", "wor", True, variance="brewer", aux=True, pooled=True),
        Method("lpm2", "spatial", "wor", True, variance="brewer", spread=True, pooled=True),
        Method("scps", "spatial", "wor", True, variance="brewer", spread=True, pooled=True),
    )
}
ALIASES = {"balanced": "cube"}
_registered: dict[str, Method] = {}


def register_method(name: str, sample: Callable, *, replacement: str = "wor", fixed_size: bool = True, probabilities: str = "unknown", variance: str = "unsupported", prn: bool = False, aux: bool = False, spread: bool = False, joint: Callable | None = None) -> Method:
    """Add a method named ``pps_...`` or ``balanced_...``.

    ``sample(pool, n, rng)`` gets a pandas frame with ``_pi`` (and ``_u`` and the plan's
    aux and spread columns) in the pool's order and returns hits per row. Plans refuse
    methods of unknown probabilities.
    """
    family = {"pps": "pps", "balanced": "balanced"}.get(name.partition("_")[0])
    if family is None or name in BUILT_IN:
        raise DesignError(f"a registered method is named pps_... or balanced_..., and not as a built-in one: {name!r}")
    if replacement not in ("wor", "wr") or probabilities not in ("exact", "approximate", "unknown"):
        raise DesignError("replacement is wor or wr; probabilities are exact, approximate or unknown")
    if variance not in ("srs", "brewer", "poisson", "wr", "unsupported"):
        raise DesignError(f"no variance family {variance!r}")
    _registered[name] = Method(name, family, replacement, fixed_size, probabilities, variance, prn, aux, spread, True, sample, joint)
    return _registered[name]


def unregister_method(name: str) -> None:
    _registered.pop(name, None)


def method(name: str) -> Method:
    name = ALIASES.get(name, name)
    found = BUILT_IN.get(name) or _registered.get(name)
    if found is None:
        raise DesignError(f"no method {name!r}; there are {', '.join([*BUILT_IN, *_registered])}")
    return found
