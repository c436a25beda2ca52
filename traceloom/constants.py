"""Fixed values of the data model and the report defaults."""

# FNV-1a 64.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3

# Token tags of effects, regions and value classes.
EFFECT_TAGS = {"write": 1, "new_region": 2, "call": 3, "syscall": 4, "branch": 5, "ret": 6, "capped": 7, "read": 8}
CALL_NAMED, CALL_ANONYMOUS = 1, 2
REGION_TAGS = {"arg": 10, "stack": 11, "heapish": 12, "global": 13}
VALUE_TAGS = {"input": 20, "input_deriv": 21, "zero": 22, "small_const": 23, "big_const": 24, "unknown": 25}

# How much each effect counts as signal.
COMPLEXITY = {"call": 3, "syscall": 3, "write": 2, "new_region": 2, "read": 1}
COMPLEXITY_RET = ("input", "input_deriv")

# Shingle tags and length, signature slots, rows of a band.
UNIGRAM, TRIGRAM, SHINGLE = 1, 3, 3
SLOTS, BAND_ROWS = 128, 4
BANDS = SLOTS // BAND_ROWS

# Constants of the 128 permutations.
PERM_A = (
    0xFF51AFD7ED558CCD,
    0xC4CEB9FE1A85EC53,
    0x9E3779B97F4A7C15,
    0x2545F4914F6CDD1D,
    0xBF58476D1CE4E5B9,
    0x94D049BB133111EB,
    0xD6E8FEB86659FD93,
    0xA0761D6478BD642F,
)
PERM_B = (
    0xE7037ED1A0B428DB,
    0x8EBC6AF09C88C6E3,
    0x589965CC75374CC3,
    0x1D8E4E27C47D124F,
    0xEB44ACCAB455D165,
    0x165667B19E3779F9,
    0x27D4EB2F165667C5,
    0x2545F4914F6CDD1D,
)
PERM_A_ADD = 0x9E3779B97F4A7C15
PERM_B_STEP = 0x2545F4914F6CDD1D
PERM_SHIFT = 29

# Gates and thresholds. Similarity lies on a grid of 128, so thresholds are also slot counts.
MIN_COMPLEXITY = 4
SAME_THRESHOLD = 0.88
QUERY_THRESHOLD = 0.7
TRIAGE_MIN_SIMILARITY, TRIAGE_MARGIN = 0.6, 0.08
CHANGES_SHOWN = 40
MAX_TEXT = 1 << 20
SOURCES = ("symtab", "dynsym", "eh_frame")

# Memory layout and caps of a traced run.
SEEDS = (0, 0x9E3779B9, 0x12345678, 0xDEADBEEF)
ARGS, ARG_BASE, ARG_STRIDE, ARG_SIZE = 6, 0x10_0000_0000, 0x01_0000_0000, 0x8000
STACK_BASE, STACK_SIZE = 0x20_0000_0000, 0x4_0000
STACK_START = STACK_BASE + STACK_SIZE // 2
PAGE = 0x1000
SMALL_CONST = 4096
OFFSET_STEP, OFFSET_LIMIT = 8, 2048
MAX_READS, MAX_HEAP_PAGES, MAX_EFFECTS = 64, 24, 96
MAX_VISITS, MAX_INSTRUCTIONS, MAX_RUN_PAGES = 64, 20_000, 256
GOLDEN = 0x9E3779B97F4A7C15
FILL_MUL_1, FILL_MUL_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
CALL_RESULT, SYSCALL_RESULT = 0x5555_0000_0000_0000, 0x6666_0000_0000_0000

# Bounds of executable files.
MAX_FILE, MAX_SEGMENT, MAX_SEGMENTS_TOTAL = 512 << 20, 1 << 30, 1 << 31


def signed(x: int) -> int:
    """The int64 with the bits of ``x`` modulo 2**64."""
    x &= 0xFFFFFFFFFFFFFFFF
    return x - (1 << 64) if x >> 63 else x
