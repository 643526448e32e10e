"""Namespaces from outside of the package: modules that register primitives, and libraries in the surface language."""

from __future__ import annotations

import importlib.util
import sys
from pathlib import Path

from rasterloom.plans.engine import LIBRARIES, PRIMITIVES
from rasterloom.plans.syntax import LanguageError, parse_program

#: The suffix of programs, and the folder of the libraries that ship.
PROGRAM = ".imgql"
OWN = Path(__file__).with_name("libraries")


def register_library(space: str, text: str) -> None:
    """The definitions of ``text`` as a namespace that programs can import; it has no goals."""
    if any(c[0] in ("print", "save") for c in parse_program(text)):
        raise LanguageError("E_IMPORT", f"the library {space} has a goal")
    LIBRARIES[space] = text


def load_folder(folder: str) -> list[str]:
    """Run each module of a folder, which may register primitives, and take each program as the library of its name.

    The names of the namespaces that are new are returned. A module that fails is an error that names it.
    """
    before = {*PRIMITIVES, *LIBRARIES}
    for path in sorted(Path(folder).iterdir()):
        if path.suffix == ".py" and not path.name.startswith("_"):
            spec = importlib.util.spec_from_file_location(f"rasterloom_plugin_{path.stem}", path)
            module = importlib.util.module_from_spec(spec)  # type: ignore[arg-type]
            sys.modules[module.__name__] = module
            try:
                spec.loader.exec_module(module)  # type: ignore[union-attr]
            except Exception as e:
                raise LanguageError("E_IMPORT", f"{path}: {e}") from e
        elif path.suffix == PROGRAM:
            register_library(path.stem, path.read_text())
    return sorted({*PRIMITIVES, *LIBRARIES} - before)


load_folder(str(OWN))
