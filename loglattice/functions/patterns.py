"""Pattern lists. All values in this module are fixed values: results depend on them."""

from __future__ import annotations

#: Hard anchors, in the order in which they are tried: pattern, type. Case does not matter.
P0 = [
    # runner
    (r"^##\[error\]", "gha_error"),
    (r"^::error::", "gha_error"),
    (r"::error\s+file=.+,line=\d+", "gha_error"),
    (r"Process completed with exit code [1-9]", "gha_exit_code"),
    (r"The process .+ failed with exit code", "gha_exit_code"),
    # C and C++
    (r":\d+:\d+: error:", "compiler_error"),
    (r"fatal error:", "compiler_error"),
    (r"undefined reference to", "linker_error"),
    (r"multiple definition of", "linker_error"),
    (r"^ld: ", "linker_error"),
    (r"collect2: error:", "linker_error"),
    (r"make(\[\d+\])?: \*\*\*", "build_error"),
    (r"^CMake Error", "build_error"),
    (r"Segmentation fault", "exception"),
    (r"==\d+==ERROR: AddressSanitizer", "exception"),
    # Java
    (r"\.java:\d+: error:", "compiler_error"),
    (r'Exception in thread ".+"', "exception"),
    (r"java\.lang\.\w+Exception", "exception"),
    (r"^\[ERROR\]", "build_error"),
    (r"BUILD FAILURE", "build_error"),
    (r"^FAILURE:", "build_error"),
    (r"BUILD FAILED", "build_error"),
    (r"> Task :.+ FAILED", "build_error"),
    # JavaScript
    (r"^npm ERR!", "build_error"),
    (r"SyntaxError:", "exception"),
    (r"TypeError:", "exception"),
    (r"ReferenceError:", "exception"),
    (r"Cannot find module", "exception"),
    (r"Error: E[A-Z]+", "exception"),
    (r"error TS\d+:", "compiler_error"),
    (r"^FAIL\s", "test_failure"),
    (r"^ERROR in", "build_error"),
    (r"Module not found:", "build_error"),
    # Python
    (r"^Traceback \(most recent call last\):", "traceback"),
    (r"SyntaxError:", "exception"),
    (r"IndentationError:", "exception"),
    (r"ImportError:", "exception"),
    (r"ModuleNotFoundError:", "exception"),
    (r"AttributeError:", "exception"),
    (r"TypeError:", "exception"),
    (r"ValueError:", "exception"),
    (r"KeyError:", "exception"),
    (r"NameError:", "exception"),
    (r"IndexError:", "exception"),
    (r"FileNotFoundError:", "exception"),
    (r"AssertionError", "assertion_error"),
    (r"^ERROR: ", "build_error"),
    (r"^FAILED\s", "test_failure"),
    (r"=+ FAILURES =+", "test_failure"),
    # C#
    (r"error CS\d{4}:", "compiler_error"),
    (r"MSBUILD : error", "build_error"),
    (r"Build FAILED", "build_error"),
    (r"Unhandled exception\.", "exception"),
    (r"System\.[A-Za-z]+Exception", "exception"),
    (r"error NU\d{4}", "build_error"),
    # Go
    (r"panic:", "panic"),
    (r"fatal error:", "exception"),
    # Rust
    (r"error\[E\d+\]:", "compiler_error"),
    (r"panicked at", "panic"),
    # PHP
    (r"Fatal error:", "exception"),
    (r"PHP Fatal error:", "exception"),
    (r"Parse error:", "exception"),
    (r"PHP Parse error:", "exception"),
    # R
    (r"^Error in .+:", "exception"),
    (r"^Error:", "exception"),
    (r"Execution halted", "exception"),
    (r"ERROR: installation of package", "build_error"),
    # tests
    (r"\bFAILED\b", "test_failure"),
    (r"FAILURES!!!", "test_failure"),
    (r"tests? failed", "test_failure"),
    (r"Failing tests:", "test_failure"),
    (r"AssertionError", "assertion_error"),
    # general
    (r"exit code [1-9]\d*", "gha_exit_code"),
    (r"returned [1-9]\d*", "gha_exit_code"),
    (r"[Pp]ermission denied", "generic_error"),
    (r"[Cc]onnection refused", "generic_error"),
    (r"No such file or directory", "generic_error"),
]

#: Soft anchors, tried where no hard one is found.
P1 = [
    (r"^##\[warning\]", "gha_warning"),
    (r"^::warning::", "gha_warning"),
    (r":\d+:\d+: warning:", "gha_warning"),
    (r"^npm WARN", "gha_warning"),
    (r"^Warning:", "gha_warning"),
    (r"warning CS\d{4}:", "gha_warning"),
    (r"^CMake Warning", "gha_warning"),
]

#: Lines of a stack trace.
STACK = [
    r"^\s+at\s+",
    r'^File ".+", line \d+',
    r"^\s+at [a-zA-Z0-9$.]+\(.+:\d+\)",
    r"^\s+at .+ in .+:line \d+",
    r"^#\d+\s+.+\(\d+\):",
    r"^Caused by:",
    r"^\s+\.\.\. \d+ more",
    r"^During handling of",
    r"^The above exception",
]

COMMAND = [
    r"^##\[command\]",
    r"^Run ",
    r"^##\[group\]",
    r"^shell:",
    r"^working-directory:",
    r"^\$\s+",
    r"^>\s+",
]

LOCATION = [
    r"[a-zA-Z0-9_/\\.-]+:\d+:\d+",
    r'File ".+", line \d+',
    r"in .+:line \d+",
    r"\([a-zA-Z0-9_/\\.-]+:\d+\)",
]

#: Anywhere in a line, in either case.
ERROR_WORDS = ["error", "fail", "exception", "fatal", "panic", "assert"]

#: Anywhere in a line, in this case.
EXCEPTION_SIGNS = ["Exception", "Error:", "error:", "FAILED", "failed", "Traceback"]

NEW_ERROR = [
    r"^##\[error\]",
    r"^::error::",
    r"^Traceback",
    r"^Exception in thread",
    r"^Error:",
    r"^FAILED",
]

#: In either case; what a critic wants to see left.
CRITIC_WORDS = ["error", "fail", "exception", "traceback", "panic", "fatal", "exit code"]

SEPARATOR = [
    r"^[-=_*#~]{10,}$",
    r"^[\s]*[-=_*#~]+[\s]*$",
    r"^\+[-+]+\+$",
]

PROGRESS = [
    r"\[\s*[=#>\s]+\]\s*\d+%",
    r"\d+%\s*\|[█▓▒░\s]+\|",
    r"^\s*\d+%\s*$",
    r"Downloading[.]+\s*\d+%",
    r"Uploading[.]+\s*\d+%",
    r"Progress:\s*\d+%",
    r"\(\d+/\d+\)",
    r"^\s*[.]+\s*$",
]

TELEMETRY = [
    r"^\s*\*+\s*$",
    r"Welcome to",
    r"Thank you for using",
    r"Please consider",
    r"Donate",
    r"Sponsor",
    r"npm notice",
    r"^\s*│\s*│\s*$",
]

#: Parameters of colour sequences that show red.
RED = ["31", "91", "1;31", "0;31", "41", "101", "31;1", "1;91"]

ERROR_MARK, GROUP_MARK, END_MARK = "##[error]", "##[group]Run ", "##[endgroup]"
CLEANUP_MARK, EXIT_MARK = "Post job cleanup.", "##[error]Process completed with exit code"

#: Forms of an answer that names lines to delete, in the order in which they are tried; the first group is the object.
DELETE_FORMS = [
    r"```(?:json)?\s*(\{[\s\S]*?\})\s*```",
    r'(\{\s*"delete"\s*:\s*\[[\d\s,]*\]\s*\})',
    r'(?s)(\{\s*"delete"\s*:\s*\[.*?\]\s*\})',
    r'(\{[\s\S]*"delete"[\s\S]*\})',
]
#: Forms of an answer that names a method, in the order in which they are tried, in either case.
METHOD_FORMS = [r"METHOD\s*:\s*([12])", r"METHOD\s+([12])"]
#: An answer that asks for more lines of a log.
MORE_FORM = r"NEED_MORE_LINES\|(HEAD|TAIL)\|(\d+)"
#: What an answer says to stop with.
STOP_WORD = "SHOULD_TERMINATE"

#: Our own default keywords; a parameter everywhere.
CRITICAL_KEYWORDS = ["error", "failed", "failure", "fatal", "exception", "traceback", "panic"]
WARNING_KEYWORDS = ["warning", "deprecated"]
