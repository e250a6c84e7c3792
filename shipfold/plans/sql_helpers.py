"""SQL text shared by oracle queries."""

# White space as the library's strip helper sees it (Unicode white space plus
# the ASCII separator controls), as an RE2 character class.
WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


# White space as a browser sees it: ECMAScript's WhiteSpace and LineTerminator.
BROWSER_WS = r"[\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def browser_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{BROWSER_WS}+|{BROWSER_WS}+$', '', 'g')"


def collapse(expr: str) -> str:
    return browser_trim(f"regexp_replace({expr}, '{BROWSER_WS}+', ' ', 'g')")
