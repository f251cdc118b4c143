"""Names of the shared fixtures for import in tests."""
from importlib import util
from pathlib import Path

_spec = util.spec_from_file_location("llm_conftest", Path(__file__).with_name("conftest.py"))
_module = util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
EDGES, LONG, frame, prose, words = _module.EDGES, _module.LONG, _module.frame, _module.prose, _module.words
