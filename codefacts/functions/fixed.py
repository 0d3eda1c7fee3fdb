"""Fixed values. They must equal the values that define the results, so they are listed as they are."""

# English words that never become a query keyword.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "at", "by", "from", "is", "are", "it",
    "this", "that", "as", "be", "can", "could", "should", "would", "will", "do", "does", "did", "not", "but", "if",
    "then", "else", "all", "any", "please", "implement", "implementing", "review", "verify", "plan", "task", "goal",
    "add", "adds", "adding", "fix", "fixes", "fixing", "check", "checks", "need", "needs", "new", "use", "uses",
    "using", "make", "makes", "making", "project", "code", "function", "functions", "module", "modules",
]

# Chinese engineering terms and the English keywords they stand for, in lookup order.
TERM_ALIASES = [
    ("按键", ["key", "button"]), ("按钮", ["button", "key"]), ("键", ["key"]),
    ("串口", ["uart", "serial", "usart"]), ("屏幕", ["lcd", "display"]), ("显示", ["lcd", "display"]),
    ("蓝牙", ["bluetooth"]), ("协议", ["protocol"]), ("初始化", ["init"]), ("驱动", ["driver"]),
    ("传感器", ["sensor"]), ("温度", ["temp"]), ("电压", ["volt"]), ("电流", ["current"]), ("电机", ["motor"]),
    ("内存", ["memory"]), ("参数", ["param"]), ("定时器", ["timer"]), ("时钟", ["clock"]),
    ("网络", ["net", "wifi"]), ("通信", ["comm"]), ("通讯", ["comm"]), ("无线", ["rf", "wireless"]),
    ("触摸", ["touch"]), ("音频", ["audio"]), ("电源", ["power"]), ("日志", ["log"]), ("配置", ["config"]),
    ("固件", ["firmware"]), ("头文件", ["header"]),
]

# Topic words of an architecture question, in lookup order.
TOPIC_ALIASES = [
    ("启动", "startup"), ("开机", "startup"), ("串口", "uart"), ("通信", "comm"), ("参数", "param"),
    ("保存", "save"), ("刷新", "refresh"), ("界面", "ui"), ("显示", "display"), ("初始化", "init"),
]
STARTUP_TERMS = ["启动", "开机", "上电"]

# Suffixes and names of the file scan.
SOURCE_SUFFIXES = [
    ".c", ".h", ".hpp", ".cc", ".cpp", ".py", ".ts", ".tsx", ".js", ".jsx", ".rs", ".go", ".java", ".kt", ".swift",
    ".rb", ".cs", ".toml", ".yaml", ".yml",
]
CONFIG_SUFFIXES = [".toml", ".yaml", ".yml"]
CODE_SUFFIXES = [s for s in SOURCE_SUFFIXES if s not in CONFIG_SUFFIXES]
CONFIG_NAMES = [
    "Makefile", "CMakeLists.txt", "pyproject.toml", "Cargo.toml", "package.json", "go.mod", "pom.xml",
    "build.gradle", "meson.build", "configure.ac",
]
SKIPPED_DIRS = [
    ".git", ".venv", "node_modules", "build", "dist", "target", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache",
]
INCLUDE_SUFFIXES = [".c", ".h", ".cpp", ".hpp", ".cc"]
LANGUAGES = {
    ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".py": "python", ".ts": "typescript",
    ".js": "javascript", ".rs": "rust", ".go": "go", ".java": "java", ".toml": "toml", ".yaml": "yaml",
    ".yml": "yaml",
}

# Build configuration files.
BUILD_CONFIG_NAMES = ["Makefile", "CMakeLists.txt", "build.ninja", "meson.build", "compile_commands.json"]
BUILD_CONFIG_SUFFIXES = ["uvprojx", "uvproj", "ewp", "ioc"]
CHIP_PREFIXES = ["gd32", "stm32", "at32", "hc32", "apm32", "n32"]

# Directory and prefix rules of module discovery.
GENERIC_DIRS = [
    "app", "user", "src", "application", "core", "common", "hal", "bsp", "drivers", "driver", "middleware", "lib",
    "library", "utilities", "utils", "main",
]
LIBRARY_DIRS = [
    "middlewares", "thirdparty", "third_party", "cmsis", "stm32cube_fw", "freertos", "rtos", "fatfs", "lvgl", "lwip",
    "usb", "components", "external", "lib", "library", "libraries", "segger", "touchgfx", "emwin", "cubemx",
    "rtthread", "rt-thread",
]
LIBRARY_PREFIXES = [
    "lv_", "lvgl", "ff_", "cmsis_", "segger_", "usbd_", "usbh_", "tusb_", "os_", "stm32f", "stm32h", "stm32g",
    "stm32l", "tflite_", "nrf_",
]
LAYER_KEYWORDS = [
    ("bsp", ["bsp"]),
    ("middleware", ["middleware", "middlewares", "thirdparty", "third_party", "freertos", "rtos", "lvgl", "fatfs",
                    "lwip", "cmsis", "segger", "touchgfx", "emwin", "rtthread"]),
    ("hal", ["hal"]),
    ("driver", ["driver", "drivers", "peripheral", "peripherals"]),
    ("app", ["app", "application", "user", "ui", "gui", "screen", "core", "main"]),
    ("lib", ["lib", "library", "libraries"]),
]
SUGGEST_LIBRARY_DIRS = [
    "middlewares", "middleware", "thirdparty", "third_party", "cmsis", "freertos", "rtos", "fatfs", "lvgl", "lwip",
    "segger", "touchgfx", "emwin", "stm32cube_fw", "components", "external",
]
SUGGEST_LIBRARY_PREFIXES = ["lv_", "stm32f", "stm32h", "stm32g", "stm32l", "ff_"]
SUGGEST_IGNORE_DIRS = [
    "demo", "examples", "example", "test", "tests", "documents", "docs", "documentation", "tools", "samples",
    "backup", "build", "dist", "out",
]
HEADER_RISK_WORDS = ["config", "types", "typedef", "common", "defs", "hal", "port"]
HEADER_SUFFIXES = [".h", ".hpp", ".hh"]

# Entry-point names and the symbols that reveal an RTOS, in probe order.
ENTRY_PATTERNS = [
    ("^(main|app_main)$", "contains main function", "high"),
    ("^startup(_\\w+)?$", "startup entry", "high"),
    ("^vTaskStartScheduler$", "RTOS scheduler start", "medium"),
    ("^osKernelStart$", "CMSIS-RTOS kernel start", "medium"),
]
TASK_CREATORS = ["xTaskCreate", "osThreadNew", "xTaskCreateStatic"]
RTOS_PROBES = [
    ("freertos", "FreeRTOS"), ("vtaskstartscheduler", "FreeRTOS"), ("xtaskcreate", "FreeRTOS"),
    ("osthreadnew", "CMSIS-RTOS2"), ("oskernelstart", "CMSIS-RTOS2"), ("rtthread", "RT-Thread"),
    ("threadcreate", "RT-Thread"),
]

# Shell commands that need approval, matched without regard to case.
RISKY_COMMANDS = [
    r"\bsudo\b", r"\brm\s+-[a-z]*[rf][a-z]*\s+[/~]", r"\bformat\b", r"\bshutdown\b", r"\brestart\b",
    r"\breg\s+(delete|add)\b", r"\bdiskpart\b", r"\bRemove-Item\b", r"\bdel\s+/[a-z]*[sq][a-z]*\b",
    r"curl\s+.*\|\s*(sh|bash)", r"git\s+push\s+--force", r"chmod\s+777", r"\bnet\s+user\b",
]
# Fixed value: first tool invocation inside prose.
COMMAND_PATTERN = (
    r"(?:^|[\n：:;；])\s*((?:gcc|cc|mingw32-make|make|python|pytest|cargo|go\s+build|node|npm|echo|del|dir)"
    r"[^\n。；;]*?)(?:$|[\n。；;])"
)

# Words in an error body that decide its class.
PARAM_WORDS = [
    "reasoning_effort", "temperature", "max_tokens", "generation", "response_format", "frequency_penalty",
    "presence_penalty", "top_p", "tools", "stop", "seed",
]
MODEL_WORDS = ["model not found", "unknown model", "invalid model", "model does not exist"]
CONTEXT_WORDS = ["context length", "maximum context", "too many tokens", "token limit"]

# Class of each action; any other action counts as CODE_WRITE.
ACTION_CLASSES = {
    "query": "READ", "search_feature": "READ", "build_status": "READ", "status": "READ", "review": "READ",
    "verify": "READ", "understand": "INDEX_WRITE", "sync": "INDEX_WRITE", "scope_update": "INDEX_WRITE",
    "reindex": "INDEX_WRITE", "human_index": "INDEX_WRITE", "plan": "CODE_WRITE_PREVIEW", "auto": "CODE_WRITE",
}

# Workflow stages and statuses, task states and the ones that end a task.
STAGES = [
    "index_check", "index_decision", "index_sync", "codegraph_analysis", "index_quality", "query_context",
    "understanding", "decision_gate", "planning", "evidence_validation", "review", "verify", "completed",
]
STATUSES = ["pending", "running", "completed", "failed"]
TERMINAL_STATES = ["COMPLETED", "FAILED", "CANCELLED"]
EVENT_KEYS = ["to", "from", "tool", "ok", "exit_code", "finding_id"]

# A macro body that counts as a plain value, and call names that register a callback.
MACRO_VALUE = (
    r'^\s*(?:0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d+)?)(?:[uUlLfF]{0,3})?|"(?:[^"\\]|\\.)*"|[A-Za-z_][A-Za-z0-9_]*)\s*$'
)
REGISTER_CALL = r"(?i)^(?:register|attach|bind|hook|install|assign|map)(?:_|\(|$)"

# Freshness, gate and impact thresholds.
FRESHNESS = {
    "source_large_files": 100, "scope_impact_files": 50, "scope_impact_ratio": 0.10,
    "scope_impact_ratio_min_files": 20, "build_impact_files": 50, "build_impact_ratio": 0.20,
    "header_impact_files": 5,
}
GATE = {"score_gap": 0.2, "public_consumers": 3, "layer_types": 2, "large_impact": 5}
ADD_OPERATIONS = ["add", "new", "create"]
