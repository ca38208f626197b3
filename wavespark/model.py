"""Tables and constants.

signals      path, name, width, type, signal_id       several paths may share one signal_id
transitions  signal_id, t, seq, v, glitch             one row per record, in file order (t, seq)

Graph tables are in GRAPH. Times are ticks as BIGINT; values are 4-state strings.
"""

SIGNALS = "path string, name string, width int, type string, signal_id string"
TRANSITIONS = "signal_id string, t long, seq long, v string, glitch boolean"
GRAPH = {
    "signals": "sig_id long, path string, parent_sig_id long, bit_off int, bit_width int",
    "endpoints": "ep_id long, sig_id long, role string, kind string, path string, file string, line int, direction string, bit_map string, bit_approx boolean, assignment string",
    "refs": "ep_id long, side string, pos int, path string",
    "assign_lhs": "lhs_path string, sig_id long",
    "hier": "path string, parent string, module string, file string, line int",
    "params": "inst_path string, pos int, name string, value string, kind string, is_local boolean, is_port boolean, is_overridden boolean",
    "global": "source string, category string, sink string",
}
#: what a signal holds before its first record
UNSET = "U"
# fixed values: defaults of the query tools
RANK_BEFORE, RANK_AFTER = 1000, 1000
TRACE_DEPTH, TRACE_NODES, TRACE_CONE = 8, 5000, 1
TRANSITION_LIMIT, FIND_LIMIT, SUGGESTIONS = 50, 20, 5
OVERVIEW_SEGMENTS = 20
GLOBAL_LOADS = 1024
STRUCT_DEPTH = 2
