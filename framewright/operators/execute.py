"""Execution: designs, continuations, phases, replicates and panels."""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DesignError, FrameError, SampleError, SamplingWarning
from ..plans.design import Design
from ..plans.methods import method
from .sample import INTERNAL, Sample, internal_columns
from .stages import empty_pools, panels as deal_panels, run_stage
from .validate import check_frame

MOST_SEED = 2**31 - 1


def execute(design: Design, frame, unit_key, *, stages: list[int] | None = None, seed: int = 1, panels: int | None = None, reps: int | None = None, validate: bool = True) -> Sample:
    """Run stages of a design on a frame, or on one frame for each stage.

    ``unit_key`` names the columns that tell the frame's units apart; it makes every
    order total. A ``Sample`` of another design as the frame starts a next phase. With
    ``reps`` the whole is drawn that often in one plan, replicate r as by ``seed + r - 1``.
    """
    design.check_complete()
    key = [unit_key] if isinstance(unit_key, str) else list(unit_key)
    if not isinstance(seed, int) or not 0 <= seed <= MOST_SEED - (reps or 1) + 1:
        raise DesignError(f"seed is a whole number from 0, and seed + reps below {MOST_SEED + 2}")
    for name, value in (("panels", panels), ("reps", reps)):
        if value is not None and (not isinstance(value, int) or value < (2 if name == "reps" else 1)):
            raise DesignError(f"{name} is a whole number above {1 if name == 'reps' else 0}")
    if reps and panels:
        raise DesignError("panels and replicates exclude each other")
    if reps and any(s.draw.prn for s in design.stages):
        raise DesignError("replicates of a draw by permanent random numbers would be the same")
    total = len(design.stages)
    wanted = list(range(1, total + 1)) if stages is None else sorted(stages)
    if not wanted or wanted[0] != 1 or wanted != list(range(1, wanted[-1] + 1)) or wanted[-1] > total:
        raise DesignError("stages start at 1, leave none out and exist; later ones continue a sample")
    frames = list(frame) if isinstance(frame, list | tuple) else [frame] * len(wanted)
    if len(frames) != len(wanted):
        raise FrameError(f"{len(wanted)} stages need one frame or as many, not {len(frames)}")
    return _run(design, wanted, frames, key, seed, None, panels, reps, validate)


def continue_sample(sample: Sample, frame, *, unit_key=None, seed: int | None = None, stages: list[int] | None = None, validate: bool = True) -> Sample:
    """Run the next stage, or stages, of the sample's own design on a new listing."""
    done = sample.stages[-1]
    total = len(sample.design.stages)
    if done >= total:
        raise SampleError("all stages of this design have run")
    wanted = [done + 1] if stages is None and not isinstance(frame, list | tuple) else stages or list(range(done + 1, total + 1))
    frames = list(frame) if isinstance(frame, list | tuple) else [frame] * len(wanted)
    key = sample.unit_key if unit_key is None else [unit_key] if isinstance(unit_key, str) else list(unit_key)
    out = _run(sample.design, wanted, frames, key, sample.seed if seed is None else seed, sample.df, None, None, validate)
    earlier = {k: v for k, v in sample.meta.items() if k in ("reps", "previous_phase")}
    return replace(out, stages=[*sample.stages, *wanted], meta=out.meta | earlier | {"continued_from": sample.stages}, frames=[*sample.frames, *out.frames])


def _run(design, wanted, frames, key, seed, before, panels, reps, validate) -> Sample:
    meta: dict = {"panels": panels, "reps": reps}
    drawn = before
    for i, (stage, frame) in enumerate(zip(wanted, frames, strict=True)):
        frame, phase = as_frame(frame, design)
        if phase is not None:
            meta["previous_phase"] = phase
        if validate:
            check_frame(design, frame, stage, key)
        if reps and "_replicate" in frame.columns:
            raise FrameError("the frame already holds replicates")
        drawn = run_stage(design.plan, stage, frame, drawn, key, seed, i == len(wanted) - 1, reps if i == 0 else None)
        if method(design.stages[stage - 1].draw.method).fixed_size is False:
            empty_pools(drawn, design.stages[stage - 1].draw.on_empty, stage, reps if i == 0 else None)
    if panels:
        drawn = deal_panels(drawn, design.plan, wanted[-1], key, panels)
    drawn = drawn.withColumn("_stage", F.lit(wanted[-1]))
    return Sample(drawn, design, list(wanted), seed, key, meta, frames, drawn=drawn, vouched=drawn)


def as_frame(frame, design: Design) -> tuple[DataFrame, Sample | None]:
    """A data frame to draw from: a sample becomes the next phase's frame, its internal
    columns gone but for the weight that it carries on."""
    if isinstance(frame, Sample):
        if frame.design == design:
            warnings.warn("a sample of this design is its own frame: this is a new phase, not a continuation", SamplingWarning, stacklevel=4)
        kept = [c for c in frame.df.columns if c not in internal_columns(frame.df) or c == "_replicate"]
        return frame.df.select(*kept, F.col("_weight").alias("_phase_weight")), frame
    names = frame.columns
    if len(set(names)) < len(names):
        raise FrameError("column names repeat")
    found = [c for c in names if INTERNAL.fullmatch(c)]
    if "_weight" in found and "_weight_1" in found:
        raise FrameError("this frame has the columns of a sample; give the sample itself to start a next phase")
    if found:
        raise FrameError(f"reserved column names: {', '.join(found)}")
    return frame, None
