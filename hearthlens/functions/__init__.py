"""Column -> Column expressions (JVM-side, whole-stage codegen friendly)."""

from hearthlens.functions.features import *  # noqa: F401,F403
