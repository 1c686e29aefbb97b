"""Named expression builders: the tools of an agent as functions over columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.images import contrasted, denoise_parameters, windowed


@dataclass(frozen=True)
class Tool:
    name: str
    build: Callable[..., Column]
    description: str = ""
    arguments: dict[str, str] = field(default_factory=dict)


class Registry:
    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def register(self, name: str, build: Callable[..., Column], description: str = "", arguments: dict[str, str] | None = None) -> None:
        self._tools[name] = Tool(name, build, description, arguments or {})

    def get(self, name: str) -> Tool | None:
        return self._tools.get(name)

    def names(self) -> list[str]:
        return sorted(self._tools)

    def execute(self, name: str, *args: Column, **kwargs: object) -> Column:
        if name not in self._tools:
            raise KeyError(f"no tool named {name}")
        return self._tools[name].build(*args, **kwargs)

    def dispatch(self, tool: Column, args: dict[str, tuple]) -> Column:
        """The result of the tool that each row names, null for an unknown or unlisted one.
        args: the arguments of each tool; those of tools that look at the image are to be
        the original image's, never those of an earlier crop."""
        out = F.lit(None)
        for name, a in args.items():
            out = F.when(tool == name, self.execute(name, *a)).otherwise(out)
        return out

    def describe(self) -> str:
        return "\n".join(f"- {t.name}({', '.join(f'{k}: {v}' for k, v in t.arguments.items())}): {t.description}" for t in self._tools.values())

    def prompt(self, template: str) -> str:
        """A prompt with the tools' descriptions in the place of {tools}."""
        return template.replace("{tools}", self.describe())


#: The tools of every session: what is registered here is there for all.
GLOBAL = Registry()


def default_registry() -> Registry:
    """The tools that are pure geometry or tooth codes."""
    from ..functions import fdi, geometry

    r = GLOBAL
    if r.names():
        return r
    r.register("fdi_label", fdi.label, "two-digit tooth number", {"quadrant": "int", "tooth_position": "int"})
    r.register("zoom_crop", lambda *a: geometry.zoomed(*a).struct(), "padded window around a box", {"bbox": "box", "width": "int", "height": "int"})
    r.register("nudge_crop", lambda *a: geometry.nudged(*a).struct(), "box shifted and rescaled", {"bbox": "box", "width": "int", "height": "int", "dx_frac": "double", "dy_frac": "double", "scale": "double"})
    r.register("contralateral_compare", lambda *a: geometry.mirrored(*a).struct(), "window on the other side", {"bbox": "box", "width": "int", "height": "int", "quadrant": "int"})
    r.register("locate_tooth", lambda b, left, top, w, h: geometry.from_centre(b, left, top, w, h).struct(), "a detection as a box of the whole image", {"box": "centre box", "left": "double", "top": "double", "width": "int", "height": "int"})
    r.register("denoise", lambda s: F.struct(*[c.alias(n) for n, c in zip(("diameter", "sigma", "kernel"), denoise_parameters(s))]), "filter parameters of a strength", {"strength": "double"})
    r.register("window_level", lambda pixels, preset="bone": windowed(preset)(pixels), "display window", {"pixels": "binary", "preset": "string"})
    r.register("enhance_contrast", lambda pixels, width, amount=1.5: contrasted(amount)(pixels, width), "contrast about the mean grey", {"pixels": "binary", "width": "int", "amount": "double"})
    return r
