"""Visit and biodiversity analytics as Spark DataFrame operators."""

from roostline.session import build_session, scratch_dir, staged

__all__ = ["build_session", "scratch_dir", "staged"]
