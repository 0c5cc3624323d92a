"""One line for each pattern, so that every one of them is seen to work.

Each line comes with the index of the first pattern of its list that it has; where an
earlier pattern has what a later one looks for, that is the earlier one.
"""

from __future__ import annotations

#: Lines for the hard patterns in their order: first pattern, line.
HARD = [
    (1, "##[error]boom"),
    (2, "::error::boom"),
    (3, "x ::error file=a.c,line=3"),
    (4, "Process completed with exit code 2"),
    (5, "The process '/bin/x' failed with exit code"),
    (6, "a.c:1:2: error: x"),
    (7, "fatal error: x.h"),
    (8, "undefined reference to `f'"),
    (9, "multiple definition of `f'"),
    (10, "ld: cannot find -lz"),
    (11, "collect2: error: ld returned"),
    (12, "make[2]: *** [all]"),
    (12, "make: *** [all]"),
    (13, "CMake Error at x"),
    (14, "Segmentation fault (core dumped)"),
    (15, "==12==ERROR: AddressSanitizer: heap"),
    (16, "A.java:7: error: x"),
    (17, 'Exception in thread "main" x'),
    (18, "java.lang.IllegalStateException"),
    (19, "[ERROR] Failed to run"),
    (20, "INFO BUILD FAILURE"),
    (21, "FAILURE: something"),
    (22, "BUILD FAILED in 3s"),
    (23, "> Task :app:test FAILED"),
    (24, "npm ERR! code"),
    (25, "SyntaxError: bad"),
    (26, "TypeError: bad"),
    (27, "ReferenceError: bad"),
    (28, "Cannot find module 'x'"),
    (29, "Error: ENOENT"),
    (30, "error TS2304: x"),
    (31, "FAIL src/x"),
    (32, "ERROR in ./x"),
    (33, "Module not found: x"),
    (34, "Traceback (most recent call last):"),
    (36, "IndentationError: x"),
    (37, "ImportError: x"),
    (38, "ModuleNotFoundError: x"),
    (39, "AttributeError: x"),
    (41, "ValueError: x"),
    (42, "KeyError: x"),
    (43, "NameError: x"),
    (44, "IndexError: x"),
    (45, "FileNotFoundError: x"),
    (46, "AssertionError"),
    (47, "ERROR: x"),
    (48, "FAILED tests/x"),
    (49, "=== FAILURES ==="),
    (50, "x.cs(1): error CS1002: ;"),
    (51, "MSBUILD : error x"),
    (22, "Build FAILED."),
    (53, "Unhandled exception. x"),
    (54, "System.NullReferenceException"),
    (55, "error NU1101"),
    (56, "panic: x"),
    (58, "error[E0382]: x"),
    (59, "thread panicked at x"),
    (7, "PHP Fatal error: x"),
    (62, "PHP Parse error:  x"),
    (32, "Error in f(x) : y"),
    (65, "Error:x"),
    (66, "Execution halted"),
    (67, "x ERROR: installation of package"),
    (68, "test FAILED"),
    (69, "FAILURES!!!"),
    (68, "3 tests failed"),
    (70, "1 test failed2"),
    (71, "Failing tests:"),
    (73, "exited, exit code 3"),
    (74, "it returned 5"),
    (75, "Permission denied"),
    (76, "connection refused"),
    (77, "No such file or directory"),
]

#: Lines for the soft patterns: first pattern, line.
SOFT = [
    (1, "##[warning]x"),
    (2, "::warning::x"),
    (3, "a.c:1:2: warning: x"),
    (4, "npm WARN x"),
    (5, "Warning: x"),
    (6, "x warning CS0168: y"),
    (7, "CMake Warning at x"),
]

#: Lines for the other lists: the list, and lines for its patterns in their order.
OTHER = {
    "STACK": ["   at x y", 'File "a.py", line 3', "\tat a.b$C(D.java:5)", "  at A in b.cs:line 9", "#12 /x.php(34): f()", "Caused by: x", "\t... 12 more", "During handling of x", "The above exception was"],
    "COMMAND": ["##[command]x", "Run x", "##[group]x", "shell: bash", "working-directory: x", "$ ls", "> ls"],
    "LOCATION": ["a/b.c:3:4", 'x File "a.py", line 3', "in a.cs:line 5", "f (a.js:5)"],
    "ERROR_WORDS": ["an eRRor", "faiLed", "EXCEPTION", "fataL", "Panic", "asserted"],
    "EXCEPTION_SIGNS": ["MyException", "OSError: x", "x error: y", "x FAILED y", "x failed y", "x Traceback"],
    "NEW_ERROR": ["##[error]x", "::error::x", "Traceback x", "Exception in thread x", "Error: x", "FAILED x"],
    "CRITIC_WORDS": ["Error", "Fail", "Exception", "Traceback", "Panic", "Fatal", "EXIT CODE"],
    "SEPARATOR": ["==========", " -*- ", "+--+--+"],
    "PROGRESS": ["[==> ] 40%", "40% |██ |", " 40% ", "Downloading... 4%", "Uploading. 4%", "Progress: 4%", "(4/5)", " ... "],
    "TELEMETRY": [" ** ", "Welcome to x", "Thank you for using x", "Please consider x", "Donate", "Sponsor us", "npm notice x", " │ │ "],
    "RED": [f"\u001b[{x}mred" for x in ("31", "91", "1;31", "0;31", "41", "101", "31;1", "1;91")],
    "none": ["", " ", "plain text", "errors-free? no", " one space", "32m", "\u001b[32mgreen", "a: b", "10 %", "returned 0", "exit code 0", "atx", "FAILing"],
}


def lines() -> list[tuple[int, str]]:
    """Every line, numbered from 1."""
    every = [t for _, t in HARD] + [t for _, t in SOFT] + [t for texts in OTHER.values() for t in texts]
    return list(enumerate(every, 1))


def sql() -> str:
    """The lines as a common table expression ``samples``."""
    rows = ", ".join(f"({i}, '{t.replace(chr(39), chr(39) * 2)}')" for i, t in lines())
    return f"samples AS (SELECT CAST(a AS BIGINT) AS line_no, b AS text FROM (VALUES {rows}) AS v(a, b))"
