from .design import Design, is_sampling_design, sampling_design
from .methods import method, register_method, unregister_method
from .spec import Bound, bound

__all__ = ["Bound", "Design", "bound", "is_sampling_design", "method", "register_method", "sampling_design", "unregister_method"]
