"""They decide results, so they are stated here as plain text."""

# --- line rules: name -> (pattern, output column of each group) ----------------
# Tried in this order; the first match wins.
LINE_RULES = {
    "pipeline_control": (
        r"^\[(\w+)\]<([\d/:.\s\-]+)\s([\-\d]+)>\s(\d+):\[(\w+)\]<([\w.]+:\d+)>\s([\w()\[\]:]+)\(.*?\):\s(.+)$",
        ["category", "stamp", "timezone_offset", "pid", "sub_category", "file_line", "function", "details_text"],
    ),
    "standard_log": (
        r"^\[(.*?)\]<([\d/:\.\s\-]+)><(.*?)>\s(.*?):\s(.*)$",
        ["category", "stamp", "file_line", "function", "data"],
    ),
    "sbsdk_logs": (
        r"^\[.*?\]<([\d/:\.\s\-]+)>\s(.*?)-(.*?)\s\|\s(.*?)\s\|\s(.*?)\s\|\s(.*?)$",
        ["stamp", "error_level", "code", "module", "function", "data"],
    ),
    "qt_ui": (
        r"^\[(.*?)\]<([\d/:\.\s\-]+)>\s(.*?),\s(.*)$",
        ["category", "stamp", "info", "data"],
    ),
    "qt_ui_chunks": (
        r"^\[(.*?)\]<([\d/:\.\s\-]+)>\s(.*)$",
        ["category", "stamp", "data"],
    ),
    "invidi_debug": (
        r"^([\d/:\s]+):\s(D.*?)\s:\s(.*)$",
        ["stamp", "component", "data"],
    ),
    "wjap_logs": (
        r"^([A-Za-z]+\s+\d+\s+[\d:]+)\s(.*?)\[(\d+)\]:\s(.*)$",
        ["stamp", "service", "pid", "data"],
    ),
    "timestamp_colon_ms": (
        r"^(([\d/]+\s\d{1,2}:\d{1,2}:\d{1,2}):(\d+).*)$",
        ["data", "stamp", "stamp_ms"],
    ),
    "generic": (
        r"^([\d/:\.\s\-]+)\s(.*)$",
        ["stamp", "data"],
    ),
}

# --- what a matching line starts with and contains; tested before the pattern --------
LINE_GATES = {
    "pipeline_control": ("[", ":["),
    "standard_log": ("[", "><"),
    "sbsdk_logs": ("[", "|"),
    "qt_ui": ("[", ","),
    "qt_ui_chunks": ("[", "]<"),
    "wjap_logs": ("", "]:"),
}

# --- other file formats ---------------------------------------------------------
VAR_FIRST_LINE = r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+"
VAR_LINE = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\d+)\s+I\s+VAR\s+-\s+([^:]+):\s+(.*)$"
)
KTRAP_NAME = "k_trap"
KTRAP_HEADER = r"(?m)^-+ TIME Received -+$"
KTRAP_DATE = r"^----+\s+(\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2})\s+----+$"
KTRAP_SOFTWARE = r"^----- Software:\s+(\S+?)\s*--\s*Model:\s*(.+?)\s*-{4,}$"

# --- topic-model line formats: log type -> (pattern, component group or 0, message group)
TOPIC_LINES = {
    "nal": (r"^\[(.*?)\]\s*(.*)", 1, 2),
    "netra": (r"^\[(.*?)\]<.*?><.*?>\s*(.*)", 1, 2),
    "stbCtrl": (r"^\[(.*?)\]<.*?><.*?>\s*(.*)", 1, 2),
    "wjap": (r"^.*\[[0-9]+\]:\s(.*)", 0, 1),
    "SBSDK": (r"^.*\s.*>\s(.*)", 0, 1),
    "default": (r"^\[(.*?)\]<.*?><.*?>\s*(.*)", 1, 2),
}

# --- message fields: text every match contains, pattern, output column of each group ---
# (the text is looked for in lower case where the pattern ignores case)
MESSAGE_FIELDS = [
    ("Interface ", r"Interface (\w+) (Connected|Not Connected)\(?(-?\d+)?\)?",
     ["interface", "connection_status", "interface_status_code"]),
    ("Need to start Auto IP thread", r"Need to start Auto IP thread for (\w+), thread \(([^)]+)\), event (-?\d+)",
     ["auto_ip_interface", "auto_ip_thread", "auto_ip_event"]),
    ("Arping for ", r"Arping for (\d+\.\d+\.\d+\.\d+)", ["arping_ip"]),
    (" MAC: ", r"(Destin\.|Source) MAC: ([0-9A-Fa-f:]+)", ["packet_mac_type", "packet_mac"]),
    (None, r"(Sender|Target) (IP|MAC)\s*:\s*([0-9A-Fa-f:.]+)",
     ["arp_details_role", "arp_details_type", "arp_details_value"]),
    ("SGS Msg <", r"SGS Msg <(\d+):(\w+)> took <(\d+) ms> SGS Return Code:<(\d+):(\w+)> rx_id:<([\w-]+)>",
     ["sgs_msg_id", "sgs_msg_type", "sgs_duration_ms", "sgs_return_code", "sgs_return_desc", "sgs_rx_id"]),
    ("MAC Select thread", r"MAC Select thread running on <(\w+)> interface", ["mac_select_interface"]),
    ("starting thread:<", r"starting thread:<(\w+ thread)>, version:<(\d+)>", ["worker_thread", "worker_thread_version"]),
    ("handed out by malloc:", r"This is the total size of memory occupied by chunks handed out by malloc:(\d+)", ["malloc_occupied"]),
    ("occupied by free (not in use) chunks", r"This is the total size of memory occupied by free \(not in use\) chunks\.:(\d+)", ["free_chunks"]),
    ("top-most releasable chunk", r"This is the size of the top-most releasable chunk.*?:(\d+)", ["topmost_chunk"]),
    ("Freed up bytes:", r"Freed up bytes:\s*(\d+)", ["freed_up_bytes"]),
    ("Used memory before GC:", r"Used memory before GC:\s*(\d+)", ["used_memory_before_gc"]),
    ("Used memory after GC:", r"Used memory after GC:\s*(\d+)", ["used_memory_after_gc"]),
    ("(via mmap)", r"Allocated\s*(\d+)\s*bytes\s*in\s*(\d+)\s*chunks\.\s*\(via mmap\)",
     ["allocated_mmap_bytes", "allocated_mmap_chunks"]),
    ("(via malloc)", r"Allocated\s*(\d+)\s*bytes\s.*\(via malloc\)", ["allocated_malloc_bytes"]),
    ("svc_name", r"(?i)svc_name\s*=\s*([\w\-]+)", ["svc_name"]),
    ("video resolution", r"(?i)video resolution[:\s]+(\d{3,4}x\d{3,4})", ["video_resolution"]),
    ("Type:<", r"Type:<(\d+):(\w+)>", ["msg_type_code", "msg_type_name"]),
    ("Class:<", r"Class:<(\d+):(\w+)>", ["msg_class_code", "msg_class_name"]),
    ("stbh:<", r"stbh:<([^>]+)>", ["stbh"]),
    ("cid:<", r"cid:<(\d+)>", ["cid"]),
    ("sid:<", r"sid:<(\d+)>", ["sid"]),
    ("sessMode:<", r"sessMode:<(\d+)>", ["sessMode"]),
]
# text columns that also get a bigint twin named <column>_num
MESSAGE_NUMBERS = [
    "malloc_occupied", "free_chunks", "topmost_chunk", "freed_up_bytes", "used_memory_before_gc",
    "used_memory_after_gc", "allocated_mmap_bytes", "allocated_mmap_chunks", "allocated_malloc_bytes",
]
# text columns stored as whole numbers
MESSAGE_CODES = ["worker_thread_version", "msg_type_code", "msg_class_code"]
MARK_TEXTS = ["ES_STB_MSG_TYPE_VIDEO_DUMP_BRCM_PROC", "DUMPING FILE "]
MARKED_EVENT = "MARKED_LOGS"
KNOWN_EVENTS = {
    "ES_STB_MSG_TYPE_CHAN_LIST_EVENT_TRANSITION": "CHAN_LIST_EVENT_TRANSITION",
    "ES_STB_MSG_TYPE_EPG_CUR_PROGRAM_ALL": "EPG_CUR_PROGRAM_ALL",
    "ES_STB_MSG_TYPE_RCA_GET_GET_TUNE_TO_SERVICE": "RCA_GET_TUNE_TO_SERVICE",
}
EPG_TEXT = "epg_set_grid_focus_channel(): invalid epg handle"
EPG_EVENT = "epg_handle_issue"
PROTECTOR_WORDS = ["ipll", "ipvod", "llot"]
PROTECTOR_EVENT = "signal_protector"
DISPLAY_DROP = r"(?i)Display Drop Detected\s*=\s*(\d+)"

# --- session words ----------------------------------------------------------------
SESSION_MARKER = "change_content"
SESSION_ALERTS = {"BlackScreen": "blackscreen", "VideoFreeze": "video freeze"}
SESSION_DROP_TEXT = "display drop detected"
SESSION_DROP_BUCKETS = [
    ("DisplayDrop_0_99", None, 100),
    ("DisplayDrop_100_299", 100, 300),
    ("DisplayDrop_300_499", 300, 500),
    ("DisplayDrop_500_699", 500, 700),
    ("DisplayDrop_700_plus", 700, None),
]
SESSION_OTHER = ["enterstandby", "day dream"]

# --- model columns ------------------------------------------------------------------
EXTRA_FEATURES = ["svc_name", "video_resolution", "connection_status"]
DOMAIN_COLUMNS = [
    "svc_name", "video_resolution", "connection_status", "category", "file_line", "function",
    "timestamp", "rx_id", "software", "model",
]
ALWAYS_TEXT = ["data", "info", "details"]

# --- names -----------------------------------------------------------------------------
RECEIVER = r"R\d{10}"
UNKNOWN_RECEIVER = "UNKNOWN_RXID"
# what Python's str.splitlines treats as an end of line
#: line ends besides line feed and carriage return
RARE_LINE_ENDS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
MAC_ADDRESS = (
    r"\b([0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2})\b"
)
IP_ADDRESS = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
LABELLED_LINE = r"^\[(.*?)\]<(.*?)><(.*?)>\s+(.*)$"
# folders and files left out of the version inventory
INVENTORY_EXCLUDES = ["node_modules", ".git", ".idea", "apps", "__pycache__", "lib", "Lib", ".gitattributes",
                      ".gitignore", "README"]
INVENTORY_EXCLUDED_ENDINGS = [".pyc", ".log"]
