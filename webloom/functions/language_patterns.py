"""Patterns that tell languages apart, by strength, in their order (which decides ties).

Not multi-line: ``^`` and ``$`` are the ends of the text.
"""

PATTERNS: dict[str, dict[str, tuple[str, ...]]] = {
    "rust": {
        "unique": (
            r"fn\s+\w+\s*\([^)]*\)\s*->",
            r"impl\s+\w+\s+for\s+",
            r"impl\s+\w+\s*\{",
            r"#\[derive\(",
            r"#\[\w+\]",
            r"pub\s*\(crate\)",
            r"&'[a-z]+\s",
            r"Box<dyn\s",
            r"Arc<Mutex<",
            r"Arc<RwLock<",
            r"Rc<RefCell<",
            r"Result<[^>]+,\s*[^>]+>",
            r"Option<[^>]+>",
            r"vec!\[",
            r"println!\(",
            r"eprintln!\(",
            r"format!\(",
            r"panic!\(",
            r"assert!\(",
            r"assert_eq!\(",
            r"\.unwrap\(\)",
            r"\.expect\(",
            r"\.unwrap_or\(",
            r"\.unwrap_or_else\(",
            r"async\s+fn\s",
            r"\.await\b",
            r"match\s+\w+\s*\{",
            r"\s=>\s",
            r"::new\(\)",
            r"&mut\s",
            r"&self\b",
            r"\bSelf\b",
            r"\btrait\s+\w+",
            r"struct\s+\w+\s*[<{]",
            r"enum\s+\w+\s*\{",
            r"\bmod\s+\w+",
            r"use\s+\w+::",
            r"use\s+super::",
            r"use\s+crate::",
            r"pub\s+use\s",
            r"if\s+let\s+Some",
            r"if\s+let\s+Ok",
            r"while\s+let\s",
            r"\.iter\(\)",
            r"\.into_iter\(\)",
            r"\.collect::<",
            r"\.map\(\|",
            r"\.filter\(\|",
            r"\.and_then\(\|",
        ),
        "strong": (
            r"pub\s+fn\s",
            r"pub\s+struct\s",
            r"pub\s+enum\s",
            r"pub\s+type\s",
            r"pub\s+const\s",
            r"pub\s+static\s",
            r"let\s+mut\s",
            r"\blet\s+\w+\s*:",
            r"->\s*Result",
            r"->\s*Option",
            r"->\s*Self",
            r"\.clone\(\)",
            r"\.to_string\(\)",
            r"\.as_str\(\)",
            r"\.as_ref\(\)",
            r"crate::",
            r"super::",
        ),
        "medium": (
            r"\bfn\s+\w+",
            r"\bconst\s+\w+",
            r"\bstatic\s+\w+",
            r"\btype\s+\w+",
            r"\bwhere\s",
            r"\bdyn\s",
            r"Box<",
            r"Vec<",
            r"HashMap<",
            r"HashSet<",
            r"BTreeMap<",
            r"\bString\b",
            r"\bi8\b",
            r"\bi16\b",
            r"\bi32\b",
            r"\bi64\b",
            r"\bu8\b",
            r"\bu16\b",
            r"\bu32\b",
            r"\bu64\b",
            r"\busize\b",
            r"\bisize\b",
            r"\bf32\b",
            r"\bf64\b",
            r"\bbool\b",
        ),
        "against": (
            r"\bfunction\s+\w+",
            r"\bdef\s+\w+\s*\(",
            r"\bclass\s+\w+\s*:",
            r"public\s+class\s",
            r"\bfunc\s+\w+",
        ),
    },
    "typescript": {
        "unique": (
            r":\s*(string|number|boolean|any|void|never|unknown)\b",
            r"<[A-Z]\w*(\s*,\s*[A-Z]\w*)*>",
            r"\binterface\s+\w+\s*(\{|extends)",
            r"\btype\s+\w+\s*=",
            r"\benum\s+\w+\s*\{",
            r"\bas\s+(string|number|boolean|any|const)",
            r"<[A-Z]\w*>",
            r"\bprivate\s+\w+:",
            r"\bpublic\s+\w+:",
            r"\bprotected\s+\w+:",
            r"\breadonly\s+\w+",
            r"\bkeyof\s",
            r"\btypeof\s+\w+\s*\[",
            r"\bextends\s+\w+\s*\?",
            r"Partial<",
            r"Required<",
            r"Readonly<",
            r"Record<",
            r"Pick<",
            r"Omit<",
            r"Exclude<",
            r"Extract<",
            r"NonNullable<",
            r"ReturnType<",
            r"InstanceType<",
            r"Promise<[^>]+>",
            r"Array<[^>]+>",
            r"Map<[^>]+>",
            r"Set<[^>]+>",
            r"\?\.",
            r"\?\?",
            r"!\.",
            r"@Injectable\(",
            r"@Component\(",
            r"@Module\(",
        ),
        "strong": (
            r"===",
            r"!==",
            r"=>\s*\{",
            r"export\s+default",
            r"import\s+.+\s+from",
            r"async\s+function",
            r"\.then\s*\(",
            r"\bconst\s+\w+",
            r"\blet\s+\w+",
            r"\bclass\s+\w+",
            r"constructor\s*\(",
        ),
        "medium": (
            r"\bfunction\s+\w+",
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
        ),
        "against": (
            r"\bfn\s+\w+",
            r"\bdef\s+\w+",
            r"\bfunc\s+\w+",
        ),
    },
    "go": {
        "unique": (
            r"func\s+\w+\s*\([^)]*\)\s*(\([^)]*\))?\s*\{",
            r"func\s*\([^)]+\)\s*\w+",
            r"\bpackage\s+\w+",
            r"import\s*\(",
            r'import\s+"[^"]+"',
            r":=",
            r"go\s+\w+",
            r"\bchan\s+\w+",
            r"<-\s*\w+",
            r"\w+\s*<-",
            r"\bdefer\s+\w+",
            r"\bselect\s*\{",
            r"\bcase\s+<-",
            r"\bstruct\s*\{",
            r"\binterface\s*\{",
            r"\bmap\[[^\]]+\]",
            r"\[\]\w+",
            r"\bmake\s*\(",
            r"fmt\.Print",
            r"fmt\.Sprintf",
            r"fmt\.Errorf",
            r"errors\.New",
            r"if\s+err\s*!=",
            r"return\s+nil\s*,",
            r"return\s+\w+,\s*nil",
            r"panic\s*\(",
            r"recover\s*\(",
            r"context\.Context",
            r"ctx\s+context\.Context",
            r"\*\w+\.\w+",
            r"&\w+\{",
            r"\.Error\(\)",
            r'json:"[^"]+"',
        ),
        "strong": (
            r"\bfunc\s+\w+",
            r"\btype\s+\w+\s+struct",
            r"\btype\s+\w+\s+interface",
            r"\bvar\s+\w+",
            r"\bconst\s+\w+",
            r"\breturn\s",
            r"if\s+\w+",
            r"for\s+\w+",
            r"range\s+\w+",
            r"\bnil\b",
        ),
        "medium": (
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"\btrue\b",
            r"\bfalse\b",
            r"\bstring\b",
            r"\bint\b",
            r"\bint64\b",
            r"\bfloat64\b",
            r"\bbyte\b",
            r"\berror\b",
        ),
        "against": (
            r"\bfn\s+\w+",
            r"\bdef\s+\w+",
            r"function\s+\w+",
            r"public\s+class\s",
            r"#\[",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "java": {
        "unique": (
            r"public\s+class\s+\w+",
            r"public\s+interface\s+\w+",
            r"public\s+enum\s+\w+",
            r"private\s+static\s+final",
            r"public\s+static\s+void\s+main",
            r"System\.out\.print",
            r"System\.err\.print",
            r"@Override\b",
            r"@Autowired\b",
            r"@Service\b",
            r"@Controller\b",
            r"@Repository\b",
            r"@Bean\b",
            r"@Entity\b",
            r"@Table\b",
            r"@Column\b",
            r"@Id\b",
            r"@RequestMapping\b",
            r"@GetMapping\b",
            r"@PostMapping\b",
            r"throws\s+\w+Exception",
            r"catch\s*\(\s*\w+Exception",
            r"new\s+\w+\(\)",
            r"ArrayList<",
            r"HashMap<",
            r"HashSet<",
            r"List<",
            r"Map<",
            r"Set<",
            r"Optional<",
            r"Stream<",
            r"\.stream\(\)",
            r"\.collect\(",
            r"Collectors\.",
            r"\.orElse\(",
            r"\.orElseThrow\(",
            r"\.isPresent\(",
            r"\.ifPresent\(",
            r"package\s+[\w.]+;",
            r"import\s+[\w.]+;",
            r"import\s+static\s",
            r"implements\s+\w+",
            r"extends\s+\w+",
        ),
        "strong": (
            r"\bpublic\s+\w+",
            r"\bprivate\s+\w+",
            r"\bprotected\s+\w+",
            r"\bstatic\s+\w+",
            r"\bfinal\s+\w+",
            r"\babstract\s+\w+",
            r"\bvoid\s+\w+",
            r"\breturn\s",
            r"\bthis\.\w+",
            r"\bsuper\.\w+",
            r"\bnew\s+\w+",
            r"try\s*\{",
            r"catch\s*\(",
            r"finally\s*\{",
        ),
        "medium": (
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"\btrue\b",
            r"\bfalse\b",
            r"\bnull\b",
            r"\bString\b",
            r"\bint\b",
            r"\blong\b",
            r"\bdouble\b",
            r"\bboolean\b",
        ),
        "against": (
            r"\bfn\s+\w+",
            r"\bdef\s+\w+",
            r"\bfunc\s+\w+",
            r"#\[",
            r":=",
        ),
    },
    "cpp": {
        "unique": (
            r"\bstd::\w+",
            r"\bnamespace\s+\w+",
            r"\busing\s+namespace",
            r"\btemplate\s*<",
            r"\bclass\s+\w+\s*(:\s*(public|private|protected))?",
            r"public\s*:",
            r"private\s*:",
            r"protected\s*:",
            r"\bvirtual\s+\w+",
            r"\boverride\b",
            r"\bfinal\b",
            r"\bconst\s+\w+\s*&",
            r"\w+&&",
            r"\bauto\s+\w+",
            r"\bdecltype\s*\(",
            r"\bconstexpr\s+",
            r"\bconsteval\s+",
            r"\bconcept\s+",
            r"\brequires\s+",
            r"\blambda\s*\[",
            r"\[\s*[=&]?\s*\]\s*\(",
            r"std::vector<",
            r"std::string",
            r"std::map<",
            r"std::unordered_map<",
            r"std::set<",
            r"std::unique_ptr<",
            r"std::shared_ptr<",
            r"std::make_unique<",
            r"std::make_shared<",
            r"std::move\(",
            r"std::forward<",
            r"std::cout",
            r"std::cin",
            r"std::endl",
            r"<<\s*std::",
            r"::\w+\s*\(",
            r"\bnew\s+\w+\(",
            r"\bdelete\s+\w+",
            r"\bdelete\[\]\s*\w+",
            r"nullptr\b",
            r"dynamic_cast<",
            r"static_cast<",
            r"reinterpret_cast<",
            r"const_cast<",
            r"\bthrow\s+",
            r"catch\s*\(\s*\w+",
            r"#include\s*<iostream>",
            r"#include\s*<vector>",
            r"#include\s*<string>",
            r"#include\s*<memory>",
            r"#include\s*<algorithm>",
        ),
        "strong": (
            r"#include\s*<[\w./]+>",
            r"#define\s+\w+",
            r"\bint\s+\w+",
            r"\bvoid\s+\w+",
            r"\breturn\s",
            r"if\s*\(",
            r"for\s*\(",
            r"while\s*\(",
        ),
        "medium": (
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"\btrue\b",
            r"\bfalse\b",
            r"\bNULL\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"public\s+class\s",
            r"package\s+[\w.]+",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "c": {
        "unique": (
            r"#include\s*<[\w./]+>",
            r'#include\s*"[\w./]+"',
            r"#define\s+\w+",
            r"#ifdef\s+\w+",
            r"#ifndef\s+\w+",
            r"#endif\b",
            r"#pragma\s+\w+",
            r"#if\s+defined",
            r"int\s+main\s*\(",
            r"void\s+main\s*\(",
            r"printf\s*\(",
            r"scanf\s*\(",
            r"fprintf\s*\(",
            r"sprintf\s*\(",
            r"malloc\s*\(",
            r"calloc\s*\(",
            r"realloc\s*\(",
            r"free\s*\(",
            r"sizeof\s*\(",
            r"memcpy\s*\(",
            r"memset\s*\(",
            r"strcpy\s*\(",
            r"strlen\s*\(",
            r"strcmp\s*\(",
            r"\bNULL\b",
            r"\bstruct\s+\w+\s*\{",
            r"\btypedef\s+struct",
            r"\btypedef\s+enum",
            r"\bunion\s+\w+",
            r"\*\w+\s*=",
            r"&\w+\b",
            r"->\w+",
            r"\bunsigned\s+(int|char|long)",
            r"\bsigned\s+(int|char|long)",
            r"\bextern\s+\w+",
            r"\bstatic\s+\w+",
            r"\bconst\s+\w+",
            r"\bvolatile\s+\w+",
            r"\bregister\s+\w+",
        ),
        "strong": (
            r"\bint\s+\w+",
            r"\bchar\s+\w+",
            r"\bfloat\s+\w+",
            r"\bdouble\s+\w+",
            r"\bvoid\s+\w+",
            r"\blong\s+\w+",
            r"\bshort\s+\w+",
            r"\breturn\s",
            r"if\s*\(",
            r"else\s*\{",
            r"for\s*\(",
            r"while\s*\(",
            r"switch\s*\(",
            r"case\s+\w+:",
        ),
        "medium": (
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"\bbreak\b",
            r"\bcontinue\b",
            r"\bgoto\s+\w+",
        ),
        "against": (
            r"\bclass\s+\w+",
            r"public\s*:",
            r"private\s*:",
            r"\bnamespace\s+",
            r"\btemplate\s*<",
            r"\bstd::",
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
        ),
    },
    "python": {
        "unique": (
            r"def\s+\w+\s*\([^)]*\)\s*:",
            r"class\s+\w+\s*(\([^)]*\))?\s*:",
            'if\\s+__name__\\s*==\\s*[\'"]__main__[\'"]',
            r"from\s+\w+\s+import\s",
            r"import\s+\w+\s+as\s+\w+",
            r"@\w+\s*(\([^)]*\))?\s*\n\s*def\s",
            r"@property\b",
            r"@staticmethod\b",
            r"@classmethod\b",
            r"@dataclass\b",
            r"self\.\w+",
            r"self\s*,",
            r"\(self\)",
            r"def\s+__init__\s*\(",
            r"def\s+__str__\s*\(",
            r"def\s+__repr__\s*\(",
            r"def\s+__len__\s*\(",
            r"def\s+__getitem__\s*\(",
            r"def\s+__setitem__\s*\(",
            r"def\s+__iter__\s*\(",
            r"def\s+__next__\s*\(",
            r"def\s+__enter__\s*\(",
            r"def\s+__exit__\s*\(",
            r"raise\s+\w+Error",
            r"except\s+\w+\s+as\s+\w+:",
            r"except\s+\w+:",
            r"with\s+\w+\([^)]*\)\s+as\s+\w+:",
            r"async\s+def\s",
            r"await\s+\w+",
            r"yield\s+from\s",
            r"lambda\s+\w*:",
            r"\[\s*\w+\s+for\s+\w+\s+in\s",
            r"\{\s*\w+:\s*\w+\s+for\s+\w+\s+in\s",
            r'f"[^"]*\{[^}]+\}[^"]*"',
            r"f'[^']*\{[^}]+\}[^']*'",
            r"\bTrue\b",
            r"\bFalse\b",
            r"\bNone\b",
            r"\band\b",
            r"\bor\b",
            r"\bnot\b",
            r"\bis\s+not\b",
            r"\bnot\s+in\b",
            r"print\s*\(",
            r"len\s*\(",
            r"range\s*\(",
            r"enumerate\s*\(",
            r"zip\s*\(",
            r"isinstance\s*\(",
            r"hasattr\s*\(",
            r"getattr\s*\(",
            r"setattr\s*\(",
            r"__all__\s*=",
            r"__version__\s*=",
        ),
        "strong": (
            r"\bdef\s+\w+",
            r"\bclass\s+\w+",
            r"\bimport\s+\w+",
            r"\bfrom\s+\w+",
            r"if\s+\w+:",
            r"elif\s+\w+:",
            r"else\s*:",
            r"for\s+\w+\s+in\s",
            r"while\s+\w+:",
            r"try\s*:",
            r"except\s*:",
            r"finally\s*:",
            r"return\s",
            r"yield\s",
        ),
        "medium": (
            r"#[^\n]+$",
            r"'''[\s\S]*?'''",
            r'\"\"\"[\s\S]*?\"\"\"',
            r":\s*int\b",
            r":\s*str\b",
            r":\s*float\b",
            r":\s*bool\b",
            r":\s*list\b",
            r":\s*dict\b",
            r"->\s*\w+",
            r"\bpass\b",
            r"\bbreak\b",
            r"\bcontinue\b",
            r"\bglobal\s+\w+",
            r"\bnonlocal\s+\w+",
            r"\bassert\s",
        ),
        "against": (
            r"\bfn\s+\w+",
            r"\bfunc\s+\w+",
            r"function\s+\w+",
            r"public\s+class\s",
            r"=>",
        ),
    },
    "ruby": {
        "unique": (
            r"def\s+\w+(\s*\([^)]*\))?\s*$",
            r"\bend\s*$",
            r"class\s+\w+\s*(<\s*\w+)?\s*$",
            r"module\s+\w+\s*$",
            'require\\s+[\'"]',
            'require_relative\\s+[\'"]',
            r"attr_accessor\s+:\w+",
            r"attr_reader\s+:\w+",
            r"attr_writer\s+:\w+",
            r":\w+\s*=>",
            r"\w+:\s*\w+",
            r"#\{[^}]+\}",
            r"@\w+\s*=",
            r"@@\w+\s*=",
            r"\$\w+\s*=",
            r"\.each\s+do\s*\|",
            r"\.map\s+do\s*\|",
            r"\.select\s+do\s*\|",
            r"\.reject\s+do\s*\|",
            r"\.reduce\s+do\s*\|",
            r"\|\w+\|",
            r"do\s*\|[^|]+\|",
            r"\{\s*\|[^|]+\|",
            r"puts\s+",
            r"gets\s*",
            r"p\s+\w+",
            r"\.nil\?",
            r"\.empty\?",
            r"\.present\?",
            r"\.blank\?",
            r"\w+\?",
            r"\w+!",
            r"unless\s+",
            r"until\s+",
            r"begin\s*$",
            r"rescue\s+",
            r"raise\s+",
            r"ensure\s*$",
            r"yield\s*",
            r"&block\)",
            r"\*args\)",
            r"\*\*kwargs\)",
            r"lambda\s*\{",
            r"->\s*\{",
            r"proc\s*\{",
        ),
        "strong": (
            r"\bdef\s+\w+",
            r"\bclass\s+\w+",
            r"\bmodule\s+\w+",
            r"\bif\s+\w+",
            r"\belsif\s+",
            r"\belse\s*$",
            r"\bwhile\s+",
            r"\bfor\s+\w+\s+in\s",
            r"\breturn\s",
            r"#[^\n{]+$",
        ),
        "medium": (
            r"\btrue\b",
            r"\bfalse\b",
            r"\bnil\b",
            r"\band\b",
            r"\bor\b",
            r"\bnot\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bfunc\s+",
            r"function\s+",
            r"public\s+class",
            r"#\[",
            r"^---\s*$",
            r"apiVersion:\s+",
            r"kind:\s+",
            r"metadata:\s*$",
            r"spec:\s*$",
            r"on:\s*$",
            r"jobs:\s*$",
            r"steps:\s*$",
            r"runs-on:\s+",
            r"uses:\s+[^@]+@",
            r"stages:\s*$",
            r"script:\s*$",
            r"pull_request:\s*$",
            r"issue_comment:\s*$",
            r"workflow_dispatch:\s*$",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "php": {
        "unique": (
            r"<\?php",
            r"\?>",
            r"\$\w+\s*=",
            r"\$\w+->",
            r"\$this->",
            r"self::",
            r"parent::",
            r"::\$\w+",
            r"function\s+\w+\s*\([^)]*\)",
            r"public\s+function",
            r"private\s+function",
            r"protected\s+function",
            r"class\s+\w+\s+(extends|implements)",
            r"\bnamespace\s+[\w\\]+",
            r"\buse\s+[\w\\]+",
            r"require_once\s+",
            r"include_once\s+",
            r"\brequire\s+",
            r"\binclude\s+",
            r"echo\s+",
            r"print\s+",
            r"var_dump\s*\(",
            r"print_r\s*\(",
            r"isset\s*\(",
            r"empty\s*\(",
            r"array\s*\(",
            r"\[.*=>",
            r"=>",
            r"\bnew\s+\w+",
            r"__construct\s*\(",
            r"__destruct\s*\(",
            r"__get\s*\(",
            r"__set\s*\(",
            r"__call\s*\(",
            r"__toString\s*\(",
        ),
        "strong": (
            r"\bfunction\s+",
            r"\bclass\s+",
            r"\binterface\s+",
            r"\btrait\s+",
            r"\bpublic\s+",
            r"\bprivate\s+",
            r"\bprotected\s+",
            r"\breturn\s",
            r"if\s*\(",
            r"foreach\s*\(",
            r"while\s*\(",
            r"for\s*\(",
        ),
        "medium": (
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"\btrue\b",
            r"\bfalse\b",
            r"\bnull\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"#\[",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "bash": {
        "unique": (
            r"#!/bin/bash",
            r"#!/bin/sh",
            r"#!/usr/bin/env\s+bash",
            r"#!/usr/bin/env\s+sh",
            r"\$\{\w+\}",
            r"\$\(\w+",
            r"`[^`]+`",
            r"\[\[\s+[^\]]+\s+\]\]",
            r"\[\s+[^\]]+\s+\]",
            r"-eq\b",
            r"-ne\b",
            r"-lt\b",
            r"-gt\b",
            r"-le\b",
            r"-ge\b",
            r"-z\s+",
            r"-n\s+",
            r"-f\s+",
            r"-d\s+",
            r"-e\s+",
            r"-r\s+",
            r"-w\s+",
            r"-x\s+",
            r"function\s+\w+\s*\(\)\s*\{",
            r"\w+\s*\(\)\s*\{",
            r"\bfi\b",
            r"\bdo\b",
            r"\bdone\b",
            r"\bthen\b",
            r"\besac\b",
            r"case\s+\$\w+\s+in",
            r"for\s+\w+\s+in\s",
            r"while\s+read",
            r"\bshift\b",
            r"\bexit\s+\d+",
            r"export\s+\w+=",
            r"source\s+",
            r"\.\s+\w+",
            r"\becho\s+",
            r"\bprintf\s+",
            r"\bread\s+",
            r"local\s+\w+=",
            r"\bset\s+-[ex]",
            r"\|\s*grep\b",
            r"\|\s*awk\b",
            r"\|\s*sed\b",
            r"\|\s*cut\b",
            r"\|\s*sort\b",
            r"\|\s*uniq\b",
            r"\|\s*head\b",
            r"\|\s*tail\b",
            r"\|\s*wc\b",
            r"\|\s*less\b",
            r"\|\s*more\b",
            r"\|\s*tee\b",
            r"\|\s*xargs\b",
            r"\|\s*tr\b",
            r"2>&1",
            r">/dev/null",
            r"<<\s*\w+",
            r"grep\s+",
            r"sed\s+",
            r"awk\s+",
            r"cut\s+",
            r"sort\s+",
            r"uniq\s+",
            r"xargs\s+",
            r"find\s+",
        ),
        "strong": (
            r"\bbrew\s*(install|update|upgrade|uninstall|search)",
            r"\bapt-get\s*(install|update|upgrade|remove)",
            r"\bapt\s*(install|update|upgrade|remove)",
            r"\byum\s*(install|update|remove)",
            r"\bcurl\s*-",
            r"\bwget\s*(http|ftp|--)",
            r"\bgit\s*(clone|pull|push|commit|add|status|checkout)",
            r"\bnpm\s*(install|run|start|build|test|init)",
            r"\byarn\s*(install|add|run|build)",
            r"\bpnpm\s*(install|add|run)",
            r"\bcargo\s*(build|run|test|install|new)",
            r"\bif\s+",
            r"\belif\s+",
            r"\belse\b",
            r"\bwhile\s+",
            r"\bfor\s+",
            r"\breturn\s+",
            r"#[^\n!]+$",
        ),
        "medium": (
            r"\btrue\b",
            r"\bfalse\b",
            r"\$\d+",
            r"\$@",
            r"\$\*",
            r"\$\?",
            r"\$\$",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"public\s+class",
            r"#\[",
        ),
    },
    "powershell": {
        "unique": (
            r"\b(Get|Set|New|Remove|Add|Clear|Copy|Move|Rename|Write|Read|Test|Invoke|Start|Stop|Restart|Enable|Disable|Import|Export|ConvertTo|ConvertFrom|Select|Where|ForEach|Sort|Group|Measure)-[A-Z]\w+",
            r"\b(irm|iex|iwr|iwk)\b",
            r"\[[A-Z]\w+(\.[A-Z]\w+)*\]::",
            r"\[scriptblock\]::",
            r"\[System\.\w+\]::",
            r"\[PSCustomObject\]",
            r"\[CmdletBinding\(\)",
            r"\[Parameter\([^\)]*\)\]",
            r"\[ValidateSet\([^\)]*\)\]",
            r"\[ValidateNotNull\(\)\]",
            r"\[ValidateNotNullOrEmpty\(\)\]",
            r"\$PSScriptRoot\b",
            r"\$PSVersionTable\b",
            r"\$PSCommandPath\b",
            r"\$PSBoundParameters\b",
            r"\$ErrorActionPreference\b",
            r"\$ProgressPreference\b",
            r"\$VerbosePreference\b",
            r"\$WarningPreference\b",
            r"\$Host\b",
            r"\$MyInvocation\b",
            r"-eq\b",
            r"-ne\b",
            r"-gt\b",
            r"-ge\b",
            r"-lt\b",
            r"-le\b",
            r"-like\b",
            r"-notlike\b",
            r"-match\b",
            r"-notmatch\b",
            r"-contains\b",
            r"-notcontains\b",
            r"-in\b",
            r"-notin\b",
            r"-and\b",
            r"-or\b",
            r"-not\b",
            r"-xor\b",
            r"\$_\.",
            r"\$PSItem\.",
            r"@\w+\s*=",
            r"@\{[^}]*\}",
            r"@\([^\)]*\)",
            '@["\']',
            '^["\']@',
        ),
        "strong": (
            r"\bfunction\s+\w+\s*\{",
            r"\bparam\s*\(",
            r"\[string\]\s*\$\w+",
            r"\[int\]\s*\$\w+",
            r"\[bool\]\s*\$\w+",
            r"\[array\]\s*\$\w+",
            r"\[hashtable\]\s*\$\w+",
            r"\bWrite-Host\b",
            r"\bWrite-Output\b",
            r"\bWrite-Error\b",
            r"\bWrite-Warning\b",
            r"\bWrite-Verbose\b",
            r"\bWrite-Debug\b",
            r"\bGet-Content\b",
            r"\bSet-Content\b",
            r"\bGet-ChildItem\b",
            r"\bGet-Process\b",
            r"\bGet-Service\b",
            r"\bTest-Path\b",
            r"\bNew-Item\b",
            r"\bRemove-Item\b",
            r"\bCopy-Item\b",
            r"\bMove-Item\b",
            r"\bforeach\s*\(\s*\$\w+\s+in\s+",
            r"\bif\s*\([^)]*-\w+\s+",
            r"\belseif\s*\(",
            r"\bswitch\s*\(\s*\$",
            r"\btry\s*\{",
            r"\bcatch\s*\{",
            r"\bfinally\s*\{",
        ),
        "medium": (
            r"\|\s*Where-Object",
            r"\|\s*Select-Object",
            r"\|\s*ForEach-Object",
            r"\|\s*Sort-Object",
            r"\|\s*Group-Object",
            r"\|\s*Measure-Object",
            r"\|\s*Out-",
            r"\b(ls|dir|cd|pwd|rm|cp|mv|cat|echo|kill|ps|sleep)\s+",
            r"<#[\s\S]*?#>",
            r"#[^\n]+$",
        ),
        "against": (
            r"\bfn\s+\w+\s*\(",
            r"\bdef\s+\w+\s*\(",
            r"public\s+class\s+\w+",
            r"\bpackage\s+\w+",
            r"#\[derive\(",
            r"\bimpl\s+\w+\s+for\s+",
            r"SELECT\s+.+\s+FROM\s+",
            r"\[package\]",
            r"\[dependencies\]",
        ),
    },
    "sql": {
        "unique": (
            r"(?i)SELECT\s+.+\s+FROM\s+",
            r"(?i)INSERT\s+INTO\s+",
            r"(?i)UPDATE\s+\w+\s+SET\s+",
            r"(?i)DELETE\s+FROM\s+",
            r"(?i)CREATE\s+TABLE\s+",
            r"(?i)ALTER\s+TABLE\s+",
            r"(?i)DROP\s+TABLE\s+",
            r"(?i)CREATE\s+INDEX\s+",
            r"(?i)CREATE\s+VIEW\s+",
            r"(?i)CREATE\s+PROCEDURE\s+",
            r"(?i)CREATE\s+FUNCTION\s+",
            r"(?i)CREATE\s+TRIGGER\s+",
            r"(?i)INNER\s+JOIN\s+",
            r"(?i)LEFT\s+JOIN\s+",
            r"(?i)RIGHT\s+JOIN\s+",
            r"(?i)FULL\s+JOIN\s+",
            r"(?i)CROSS\s+JOIN\s+",
            r"(?i)ON\s+\w+\.\w+\s*=",
            r"(?i)WHERE\s+",
            r"(?i)GROUP\s+BY\s+",
            r"(?i)HAVING\s+",
            r"(?i)ORDER\s+BY\s+",
            r"(?i)LIMIT\s+\d+",
            r"(?i)OFFSET\s+\d+",
            r"(?i)DISTINCT\s+",
            r"(?i)AS\s+\w+",
            r"(?i)COUNT\s*\(",
            r"(?i)SUM\s*\(",
            r"(?i)AVG\s*\(",
            r"(?i)MAX\s*\(",
            r"(?i)MIN\s*\(",
            r"(?i)COALESCE\s*\(",
            r"(?i)CASE\s+WHEN\s+",
            r"(?i)THEN\s+",
            r"(?i)ELSE\s+",
            r"(?i)END\s*$",
            r"(?i)PRIMARY\s+KEY",
            r"(?i)FOREIGN\s+KEY",
            r"(?i)REFERENCES\s+",
            r"(?i)NOT\s+NULL",
            r"(?i)UNIQUE\s+",
            r"(?i)DEFAULT\s+",
            r"(?i)AUTO_INCREMENT",
            r"(?i)SERIAL\b",
            r"(?i)VARCHAR\s*\(",
            r"(?i)INTEGER\b",
            r"(?i)BOOLEAN\b",
            r"(?i)TIMESTAMP\b",
            r"(?i)BEGIN\s+TRANSACTION",
            r"(?i)COMMIT\s*;",
            r"(?i)ROLLBACK\s*;",
        ),
        "strong": (
            r"(?i)SELECT\s+",
            r"(?i)FROM\s+",
            r"(?i)AND\s+",
            r"(?i)OR\s+",
            r"(?i)IN\s*\(",
            r"(?i)LIKE\s+",
            r"(?i)BETWEEN\s+",
            r"(?i)IS\s+NULL",
            r"(?i)IS\s+NOT\s+NULL",
        ),
        "medium": (
            r"--[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"(?i)NULL\b",
            r"(?i)TRUE\b",
            r"(?i)FALSE\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+",
            r"#\[",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "javascript": {
        "unique": (
            r"===",
            r"!==",
            r"=>\s*\{",
            r"=>\s*[^{]",
            r"export\s+default",
            r"export\s+const",
            r"export\s+function",
            r"export\s+class",
            'import\\s+.+\\s+from\\s+[\'""]',
            r"import\s*\{[^}]+\}\s*from",
            'require\\s*\\([\'""]',
            r"module\.exports",
            r"exports\.\w+",
            r"async\s+function",
            r"\.then\s*\(",
            r"\.catch\s*\(",
            r"\.finally\s*\(",
            r"new\s+Promise",
            r"Promise\.(all|race|resolve|reject)",
            r"class\s+\w+\s+extends",
            r"constructor\s*\(",
            r"this\.\w+",
            r"\btypeof\s",
            r"\binstanceof\s",
            r"\bundefined\b",
            r"JSON\.(parse|stringify)",
            r"console\.(log|error|warn|info|debug)",
            r"document\.\w+",
            r"window\.\w+",
            r"addEventListener\s*\(",
            r"querySelector(All)?\s*\(",
            r"getElementById\s*\(",
            r"fetch\s*\(",
            r"\.map\s*\(\s*\w+\s*=>",
            r"\.filter\s*\(\s*\w+\s*=>",
            r"\.reduce\s*\(\s*\(",
            r"\.forEach\s*\(",
            r"\.find\s*\(\s*\w+\s*=>",
            r"\.some\s*\(\s*\w+\s*=>",
            r"\.every\s*\(\s*\w+\s*=>",
            r"\.\.\.\w+",
            r"`[^`]*\$\{",
        ),
        "strong": (
            r"\bconst\s+\w+",
            r"\blet\s+\w+",
            r"\bvar\s+\w+",
            r"\bfunction\s+\w+",
            r"\breturn\s",
            r"if\s*\([^)]+\)",
            r"else\s*\{",
            r"for\s*\([^)]+\)",
            r"while\s*\([^)]+\)",
            r"\bclass\s+\w+",
            r"\bnew\s+\w+",
            r"\bthrow\s",
            r"try\s*\{",
            r"catch\s*\(",
        ),
        "medium": (
            r"//[^\n]+$",
            r"/\*[\s\S]*?\*/",
            r"\btrue\b",
            r"\bfalse\b",
            r"\bnull\b",
            r"Array\.(isArray|from|of)",
            r"Object\.(keys|values|entries|assign)",
        ),
        "against": (
            r"\bfn\s+\w+",
            r"\bdef\s+\w+\s*\(",
            r"\bfunc\s+\w+",
            r"public\s+class\s",
        ),
    },
    "toml": {
        "unique": (
            r"\[\w+\]",
            r"\[\[\w+\]\]",
            r"\[[\w.]+\]",
            r'^\w+\s*=\s*"[^"]*"',
            r"^\w+\s*=\s*'[^']*'",
            r"^\w+\s*=\s*\d+",
            r"^\w+\s*=\s*(true|false)",
            r"^\w+\s*=\s*\[",
            r"^\w+\s*=\s*\{",
            r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}",
            r"\[package\]",
            r"\[dependencies\]",
            r"\[dev-dependencies\]",
            r"\[build-dependencies\]",
            r"\[features\]",
            r"\[workspace\]",
            r"\[profile\.\w+\]",
            r"\[tool\.\w+\]",
            r'version\s*=\s*"[^"]*"',
            r'edition\s*=\s*"\d{4}"',
            r'name\s*=\s*"[^"]*"',
            r'path\s*=\s*"[^"]*"',
            r"workspace\s*=\s*(true|false)",
        ),
        "strong": (
            r'=\s*"[^"]*"',
            r"=\s*\d+",
            r"=\s*(true|false)",
        ),
        "medium": (
            r"#[^\n]+$",
            r"\btrue\b",
            r"\bfalse\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+",
            r"public\s+class",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
            r"\b(irm|iex|iwr)\b",
            r"\[[A-Z]\w+\]::",
            r"-(eq|ne|like|match|contains)\b",
            r"\$(PSScriptRoot|PSVersionTable)\b",
            r"\b(Get|Set|Invoke|Write)-[A-Z]\w+",
        ),
    },
    "yaml": {
        "unique": (
            r"^---\s*$",
            r"^\.\.\.\s*$",
            r"^\w+:\s*$",
            r"^\w+:\s+\|",
            r"^\w+:\s+>",
            r"^\s+-\s+\w+:\s+",
            '^\\s+-\\s+["\'][^"\']*["\']',
            r"^\s+-\s+\d+",
            r"^\s+\w+:\s+",
            r"\&\w+",
            r"\*\w+",
            r"<<:\s*\*\w+",
            r"!\w+",
            r"!!\w+",
            r"\{\{[^}]+\}\}",
            r"apiVersion:\s+",
            r"kind:\s+",
            r"metadata:\s*$",
            r"spec:\s*$",
            r"name:\s+",
            r"image:\s+",
            r"version:\s+",
            r"services:\s*$",
            r"volumes:\s*$",
            r"environment:\s*$",
            r"ports:\s*$",
            r"on:\s*$",
            r"jobs:\s*$",
            r"steps:\s*$",
            r"runs-on:\s+",
            r"uses:\s+[^@]+@",
            r"with:\s*$",
            r"run:\s+\|",
            r"env:\s*$",
            r"stages:\s*$",
            r"script:\s*$",
            r"before_script:\s*$",
            r"after_script:\s*$",
            r"variables:\s*$",
            r"only:\s*$",
            r"except:\s*$",
            r"pull_request:\s*$",
            r"issue_comment:\s*$",
            r"workflow_dispatch:\s*$",
            r"schedule:\s*$",
            r"types:\s*\[",
        ),
        "strong": (
            r"^\w+:",
            r"^\s+-\s+",
        ),
        "medium": (
            r"#[^\n]+$",
            r"\btrue\b",
            r"\bfalse\b",
            r"\bnull\b",
            r"\byes\b",
            r"\bno\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+",
            r"public\s+class",
            r"\{[^}]+:",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "json": {
        "unique": (
            r"^\s*\{\s*$",
            r"^\s*\}\s*$",
            r"^\s*\[\s*$",
            r"^\s*\]\s*$",
            r'"[^"]+"\s*:\s*\{',
            r'"[^"]+"\s*:\s*\[',
            r'"[^"]+"\s*:\s*"[^"]*"',
            r'"[^"]+"\s*:\s*\d+',
            r'"[^"]+"\s*:\s*(true|false)',
            r'"[^"]+"\s*:\s*null',
            r",\s*$",
            r'^\s*"[^"]+"\s*:',
        ),
        "strong": (
            r'"[^"]+"\s*:',
            r":\s*\[",
            r":\s*\{",
        ),
        "medium": (
            r"\btrue\b",
            r"\bfalse\b",
            r"\bnull\b",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+",
            r"#[^\n]+$",
            r"//[^\n]+$",
        ),
    },
    "css": {
        "unique": (
            r"#[a-zA-Z_][a-zA-Z0-9_-]*\s*\{",
            r"\.[a-zA-Z_][a-zA-Z0-9_-]*\s*\{",
            r"[a-zA-Z]+\s*\{[^}]*\}",
            r"@media\s+",
            r"@keyframes\s+",
            r"@import\s+",
            r"@font-face\s*\{",
            r"@charset\s+",
            r"@supports\s+",
            r"@page\s*\{",
            r":\s*hover\s*\{",
            r":\s*active\s*\{",
            r":\s*focus\s*\{",
            r":\s*visited\s*\{",
            r":\s*first-child",
            r":\s*last-child",
            r":\s*nth-child\(",
            r"::\s*before",
            r"::\s*after",
            r"::\s*placeholder",
            r"background(-color)?:\s*",
            r"color:\s*",
            r"font(-size|-family|-weight)?:\s*",
            r"margin(-top|-right|-bottom|-left)?:\s*",
            r"padding(-top|-right|-bottom|-left)?:\s*",
            r"border(-radius|-width|-color)?:\s*",
            r"display:\s*(block|inline|flex|grid|none)",
            r"position:\s*(relative|absolute|fixed|sticky)",
            r"flex(-direction|-wrap|-grow|-shrink)?:\s*",
            r"grid(-template|-area|-gap)?:\s*",
            r"width:\s*",
            r"height:\s*",
            r"z-index:\s*",
            r"opacity:\s*",
            r"transform:\s*",
            r"transition:\s*",
            r"animation:\s*",
            r"box-shadow:\s*",
            r"text-align:\s*",
            r"text-decoration:\s*",
            r"line-height:\s*",
            r"overflow:\s*",
            r"cursor:\s*",
            r"visibility:\s*",
            r"#[0-9a-fA-F]{3,8}\b",
            r"rgb\s*\(",
            r"rgba\s*\(",
            r"hsl\s*\(",
            r"hsla\s*\(",
            r"var\s*\(--",
            r"calc\s*\(",
            r"\d+px",
            r"\d+em",
            r"\d+rem",
            r"\d+%",
            r"\d+vh",
            r"\d+vw",
            r"!important",
        ),
        "strong": (
            r"\{[^}]*\}",
            r"\w+:\s*[^;]+;",
        ),
        "medium": (
            r"/\*[\s\S]*?\*/",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+",
            r"public\s+class",
            r"//[^\n]+$",
            r"\bbrew\s+install",
            r"\bapt-get\s+",
            r"\bcurl\s+-",
            r"\bwget\s+",
            r"\bgit\s+(clone|pull|push)",
            r"\bnpm\s+(install|run)",
            r"\byarn\s+(install|add)",
            r"\bcargo\s+(build|run)",
            '\\bexport\\s+\\w+=[\'\\"]',
            r"#!/bin/(bash|sh)",
        ),
    },
    "html": {
        "unique": (
            r"<!DOCTYPE\s+html>",
            r"<html[\s>]",
            r"</html>",
            r"<head[\s>]",
            r"</head>",
            r"<body[\s>]",
            r"</body>",
            r"<title>",
            r"</title>",
            r"<meta\s+",
            r"<link\s+",
            r"<script[\s>]",
            r"</script>",
            r"<style[\s>]",
            r"</style>",
            r"<div[\s>]",
            r"</div>",
            r"<span[\s>]",
            r"</span>",
            r"<p[\s>]",
            r"</p>",
            r"<a\s+href",
            r"</a>",
            r"<img\s+",
            r"<input[\s>]",
            r"<button[\s>]",
            r"</button>",
            r"<form[\s>]",
            r"</form>",
            r"<table[\s>]",
            r"</table>",
            r"<tr[\s>]",
            r"</tr>",
            r"<td[\s>]",
            r"</td>",
            r"<th[\s>]",
            r"</th>",
            r"<ul[\s>]",
            r"</ul>",
            r"<ol[\s>]",
            r"</ol>",
            r"<li[\s>]",
            r"</li>",
            r"<h[1-6][\s>]",
            r"</h[1-6]>",
            r"<nav[\s>]",
            r"</nav>",
            r"<header[\s>]",
            r"</header>",
            r"<footer[\s>]",
            r"</footer>",
            r"<section[\s>]",
            r"</section>",
            r"<article[\s>]",
            r"</article>",
            r"<aside[\s>]",
            r"</aside>",
            r"<main[\s>]",
            r"</main>",
            r'class="[^"]*"',
            r'id="[^"]*"',
            r'style="[^"]*"',
            r'src="[^"]*"',
            r'href="[^"]*"',
            r'alt="[^"]*"',
            r'type="[^"]*"',
            r'name="[^"]*"',
            r'value="[^"]*"',
            r'data-\w+="[^"]*"',
            r'onclick="[^"]*"',
            r'onload="[^"]*"',
        ),
        "strong": (
            r"<\w+[\s>]",
            r"</\w+>",
            r'<\w+\s+\w+="[^"]*"',
            r"<br\s*/?\s*>",
            r"<hr\s*/?\s*>",
        ),
        "medium": (
            r"<!--[\s\S]*?-->",
            r"&nbsp;",
            r"&lt;",
            r"&gt;",
            r"&amp;",
        ),
        "against": (
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+\w+\s*\(",
            r"public\s+class",
        ),
    },
    "xml": {
        "unique": (
            r"<\?xml\s+version",
            r"<\?xml-stylesheet",
            r"<!DOCTYPE\s+\w+",
            r"<!\[CDATA\[",
            r"\]\]>",
            r"xmlns:\w+=",
            r"xmlns=",
            r"xsi:schemaLocation",
            r"<\w+:\w+[\s>]",
            r"</\w+:\w+>",
            r'<\w+\s+\w+:\w+="[^"]*"',
            r"<!ENTITY\s+",
            r"<!ELEMENT\s+",
            r"<!ATTLIST\s+",
            r"&\w+;",
        ),
        "strong": (
            r"<\w+[\s>]",
            r"</\w+>",
            r'<\w+\s+\w+="[^"]*"',
            r"/>",
        ),
        "medium": (
            r"<!--[\s\S]*?-->",
        ),
        "against": (
            r"<!DOCTYPE\s+html>",
            r"<html[\s>]",
            r"\bfn\s+",
            r"\bdef\s+",
            r"\bfunc\s+",
            r"function\s+",
        ),
    },
}
