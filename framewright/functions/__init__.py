from .ordering import Asc, Desc, Serp, desc, serp
from .prn import rotate, uniform, uniform_sql

__all__ = ["Asc", "Desc", "Serp", "desc", "rotate", "serp", "uniform", "uniform_sql"]
