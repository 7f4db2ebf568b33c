"""One tree of errors, by topic."""


class SamplingError(Exception):
    """Base of everything this engine refuses."""


class DesignError(SamplingError):
    """A plan that cannot be right, whatever the data."""


class AllocationError(SamplingError):
    """Sizes that cannot be met or computed."""


class AuxiliaryError(SamplingError):
    """A table of stratum attributes that does not fit the strata."""


class FrameError(SamplingError):
    """Data that do not fit the plan; ``issues`` lists what is wrong."""

    def __init__(self, message: str, issues: list[str] | None = None) -> None:
        super().__init__(message)
        self.issues = issues or [message]


class SelectionError(SamplingError):
    """A draw that cannot be made, such as an empty one where that is refused."""


class SampleError(SamplingError):
    """A sample that was changed, or holds several replicates where one is needed."""


class DigestError(SamplingError):
    """A report table that breaks its own rules."""


class ExportError(SamplingError):
    """A design without an estimator for its variance."""


class ReplayError(SamplingError):
    """A design file that cannot be read or run again."""


class SamplingWarning(UserWarning):
    """Something the engine did that the user may not expect."""
