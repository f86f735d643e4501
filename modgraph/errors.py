"""Everything that can go wrong, with the messages the command line prints."""


class AnalysisError(Exception):
    """Base of all errors of this package."""


class ModuleNotFound(AnalysisError):
    """A module that is not in the graph, or not in any test target."""

    def __init__(self, module_path: str):
        self.module_path = module_path
        super().__init__(f"Module not found: {module_path}")


class RuleConfigError(AnalysisError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"Invalid rule config ({path}): {reason}")


class UnknownRuleModule(AnalysisError):
    def __init__(self, module: str, rule: str):
        super().__init__(f"Rule references unknown module '{module}' (in rule '{rule}')")


class ModuleAnalysisFailed(AnalysisError):
    def __init__(self, module_path: str, file: str, message: str):
        super().__init__(f"Error analyzing module '{module_path}' (file '{file}'): {message}")


class InvalidCrateRoot(AnalysisError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"Invalid crate root: {path} - {reason}")


class CrateInfoError(AnalysisError):
    """The crate cannot be read."""


class UndeclaredModule(CrateInfoError):
    """A module path that leads to no file and no inline module."""

    def __init__(self, module_path: str):
        super().__init__(f"Module '{module_path}' not found")


class ParseError(CrateInfoError):
    def __init__(self, path: str, message: str):
        self.path, self.message = path, message
        super().__init__(f"Failed to parse file '{path}': {message}")


class PathTraversal(CrateInfoError):
    def __init__(self):
        super().__init__("Resolved path escapes crate root")


class FileTooLarge(CrateInfoError):
    def __init__(self, path: str, size: int, limit: int):
        super().__init__(f"File '{path}' is too large: {size} bytes (limit: {limit} bytes)")
