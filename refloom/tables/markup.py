"""Fixed values of the wiki markup: link schemes, special tags, list markers."""

# Link schemes that need `//` and those that do not.
SCHEMES_WITH_SLASHES = [
    "ftp", "ftps", "git", "gopher", "http", "https", "irc", "ircs", "mms", "nntp", "redis", "sftp", "ssh", "svn",
    "telnet", "worldwind",
]
SCHEMES_WITHOUT_SLASHES = ["bitcoin", "geo", "magnet", "mailto", "news", "sip", "sips", "sms", "tel", "urn", "xmpp"]

# Tags whose content is not wiki markup.
OPAQUE_TAGS = [
    "categorytree", "ce", "chem", "gallery", "graph", "hiero", "imagemap", "inputbox", "math", "nowiki", "pre",
    "score", "section", "source", "syntaxhighlight", "templatedata", "timeline",
]

# Tags whose content is not shown as text.
INVISIBLE_TAGS = [
    "categorytree", "gallery", "graph", "imagemap", "inputbox", "math", "score", "section", "templatedata",
    "timeline",
]

# Tags that never have a closing tag, and those that may lack one.
VOID_TAGS = ["br", "wbr", "hr", "meta", "link", "img"]
SINGLE_TAGS = [*VOID_TAGS, "li", "dt", "dd", "th", "td", "tr"]

# List markers at the start of a line.
LIST_TAGS = {"#": "li", "*": "li", ";": "dt", ":": "dd"}

INITIAL_SECTION = "Initial Section"
