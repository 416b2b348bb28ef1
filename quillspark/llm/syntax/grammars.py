"""The bundled grammars. Precedence of operators is left out, since it doesn't bear on validity."""

JSON = """
file: value END
value: '{' [member (',' member)*] '}' | '[' [value (',' value)*] ']' | STRING | NUMBER | 'true' | 'false' | 'null'
member: STRING ':' value
"""

PYTHON = """
file: (NEWLINE | stmt)* END
stmt: line | compound
line: small (';' small)* [';'] NEWLINE
small: expr_stmt | 'del' items | 'pass' | 'break' | 'continue' | 'return' [items] | 'raise' [test ['from' test]] | 'import' dotted_as (',' dotted_as)* | 'from' from_what
    | 'global' NAME (',' NAME)* | 'nonlocal' NAME (',' NAME)* | 'assert' test [',' test] | TYPE NAME [tparams] '=' test
from_what: (('.' | '...')+ [dotted] | dotted) 'import' ('*' | name_as (',' name_as)* | '(' name_as (',' name_as)* [','] ')')
dotted: NAME ('.' NAME)*
dotted_as: dotted ['as' NAME]
name_as: NAME ['as' NAME]
expr_stmt: yieldable [':' test ['=' yieldable] | AUG yieldable | ('=' yieldable)+]
yieldable: 'yield' ['from' test | items] | items
items: plain_item (',' plain_item)* [',']
plain_item: '*' ortest | test
subjects: item (',' item)* [',']
item: '*' ortest | named
named: test [':=' test]
test: 'lambda' [lparams] ':' test | ortest ['if' ortest 'else' test]
ortest: unary (BINOP unary | '*' unary | '**' unary | '-' unary | '@' unary | '/' unary | 'in' unary | 'not' 'in' unary | 'is' unary | '|' unary)*
unary: ('-' | '~' | 'not' | 'await')* atom trailer*
atom: NAME | NUMBER | STRING+ | '...' | '(' [inside] ')' | '[' [inside] ']' | '{' [entries] '}' | MATCHNAME
inside: 'yield' ['from' test | items] | entry (compfor | (',' entry)* [','])
entry: item ['as' target]
entries: pair (compfor | (',' pair)* [','])
pair: '**' ortest | '*' ortest | named [':' test]
compfor: (['async'] 'for' target (',' target)* [','] 'in' ortest | 'if' condition)+
condition: 'lambda' [lparams] ':' test | ortest [':=' test]
target: ['*'] atom trailer*
trailer: '(' [args] ')' | '[' subscript (',' subscript)* [','] ']' | '.' NAME
args: arg (',' arg)* [',']
arg: '*' test | '**' test | named ['=' test] [compfor]
subscript: '*' ortest | named [':' [test] [':' [test]]] | ':' [test] [':' [test]]
params: param (',' param)* [',']
param: NAME [':' test] ['=' test] | '*' [NAME [':' item]] | '**' NAME [':' test] | '/'
lparams: lparam (',' lparam)* [',']
lparam: NAME ['=' test] | '*' [NAME] | '**' NAME | '/'
tparams: '[' tparam (',' tparam)* [','] ']'
tparam: NAME [':' test] ['=' test] | '*' NAME | '**' NAME
suite: line | NEWLINE INDENT stmt+ DEDENT
compound: 'if' named ':' suite ('elif' named ':' suite)* ['else' ':' suite]
    | 'while' named ':' suite ['else' ':' suite]
    | for_stmt | with_stmt | def_stmt
    | 'try' ':' suite (('except' ['*'] [test ['as' NAME]] ':' suite)+ ['else' ':' suite] ['finally' ':' suite] | 'finally' ':' suite)
    | 'class' NAME [tparams] ['(' [args] ')'] ':' suite
    | 'async' (def_stmt | for_stmt | with_stmt)
    | ('@' named NEWLINE)+ (def_stmt | 'async' def_stmt | 'class' NAME [tparams] ['(' [args] ')'] ':' suite)
    | MATCH subjects ':' NEWLINE INDENT case_block+ DEDENT
for_stmt: 'for' target (',' target)* [','] 'in' items ':' suite ['else' ':' suite]
with_stmt: 'with' with_item (',' with_item)* ':' suite
with_item: test ['as' target]
def_stmt: 'def' NAME [tparams] '(' [params] ')' ['->' test] ':' suite
case_block: CASE patterns ['if' named] ':' suite
patterns: pattern (',' pattern)* [',']
pattern: '*' NAME | closed ('|' closed)* ['as' NAME]
closed: ['-'] NUMBER [('-' | BINOP) NUMBER] | STRING+ | (NAME | MATCHNAME) ('.' NAME)* ['(' [pattern_arg (',' pattern_arg)* [',']] ')'] | '(' [patterns] ')' | '[' [patterns] ']'
    | '{' [map_pattern (',' map_pattern)* [',']] '}'
pattern_arg: pattern ['=' pattern]
map_pattern: '**' NAME | closed ':' pattern
"""

GO = """
file: 'package' NAME ';' ('import' imports ';')* (top ';')* END
imports: import_spec | '(' [import_spec] (';' [import_spec])* ')'
import_spec: [NAME | '.'] STRING
top: decl | 'func' ['(' [params] ')'] NAME ['[' tparams ']'] signature [block]
decl: 'const' specs | 'var' specs | 'type' typespecs
specs: spec | '(' [spec] (';' [spec])* ')'
spec: NAME (',' NAME)* [type] ['=' exprs]
typespecs: typespec | '(' [typespec] (';' [typespec])* ')'
typespec: NAME ['[' tparams ']'] ['='] type
tparams: tparam (',' tparam)* [',']
tparam: NUMBER | union [union]
union: ['~'] type ('|' ['~'] type)*
signature: '(' [params] ')' [result]
result: '(' [params] ')' | plain_type
params: param (',' param)* [',']
param: '...' type | type ['...' type | type]
type: plain_type | '(' type ')'
plain_type: NAME ['.' NAME] ['[' tparams ']'] | '*' type | '[]' type | '[' ('...' | expr) ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' signature | struct | interface
struct: 'struct' '{' [field] (';' [field])* '}'
field: '*' NAME ['.' NAME] [STRING] | NAME [(',' NAME)* type | '.' NAME] [STRING]
interface: 'interface' '{' [element] (';' [element])* '}'
element: NAME [signature | '.' NAME ] ('|' ['~'] type)* | '~' type ('|' ['~'] type)* | '*' type | '[]' type
block: '{' [stmts] '}'
stmts: stmt (';' [stmt])* | (';' [stmt])+
stmt: decl | block | if | for | switch | 'select' (BLOCK | '{') [clauses] '}' | 'return' [exprs] | 'go' expr | 'defer' expr | 'break' [NAME] | 'continue' [NAME] | 'goto' NAME | 'fallthrough' | simple [':' [stmt]]
simple: exprs [(':=' | '=' | AUG) ['range'] exprs | '++' | '--'] | 'range' expr
if: 'if' [simple] [';' [simple]] BLOCK [stmts] '}' ['else' (if | block)]
for: 'for' [simple] [';' [simple] ';' [simple]] BLOCK [stmts] '}'
switch: 'switch' [simple] [';' [simple]] BLOCK [clauses] '}'
clauses: clause+
clause: ('case' exprs [(':=' | '=') expr] | 'default') ':' [stmts]
exprs: expr (',' expr)*
expr: unary ((BINOP | '*' | '<-' | '|' | '~') unary)*
unary: (UNARY | BINARY_OR_UNARY | '*' | '<-' | '~')* operand trailer*
operand: NAME | LITERAL | NUMBER | STRING | '(' expr ')' | 'func' signature [block] | '[]' type | '[' ('...' | expr) ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | struct | interface
trailer: '.' (NAME | '(' (type | 'type') ')') | '[' index ']' | '(' [args] ')' | '{' [elements] '}'
index: expr (',' expr)* [','] [':' [expr] [':' expr]] | ':' [expr] [':' expr]
args: arg (',' arg)* [',']
arg: expr ['...']
elements: composite (',' composite)* [',']
composite: value [':' value]
value: expr | '{' [elements] '}'
""".replace("(BINOP | '*' | '<-' | '|' | '~')", "(BINOP | BINARY_OR_UNARY | '*' | '<-' | '|')")

JAVA = """
file: [package] ('import' ['static'] NAME ('.' NAME)* ['.' '*'] ';' | ';')* (modifier* type_decl | ';')* END
package: 'package' NAME ('.' NAME)* ';'
modifier: MODIFIER | 'static' | 'final' | 'default' | 'synchronized' | annotation
annotation: '@' NAME ('.' NAME)* ['(' [annotation_args] ')']
annotation_args: annotation_arg (',' annotation_arg)* [',']
annotation_arg: expr | annotation | array_init
array_init: '{' [init (',' init)*] [','] '}'
init: expr | array_init | annotation
type_decl: 'class' NAME [tparams] ['extends' type] ['implements' types] [PERMITS types] class_body
    | 'interface' NAME [tparams] ['extends' types] [PERMITS types] class_body
    | 'enum' NAME ['implements' types] '{' [constants] [';' member*] '}'
    | RECORD NAME [tparams] '(' [params] ')' ['implements' types] class_body
    | ANNOTATION_TYPE NAME class_body
constants: ',' | constant (',' constant)* [',']
constant: annotation* NAME ['(' [args] ')'] [class_body]
class_body: '{' member* '}'
member: ';' | block | modifier+ (declared | block) | declared
declared: type_decl | [tparams] (simple_type (NAME rest | callable) | 'void' NAME callable)
rest: callable | ('[]')* ['=' init] (',' declarator)* ';'
declarator: NAME ('[]')* ['=' init]
callable: '(' [params] ')' ('[]')* ['throws' types] (block | 'default' init ';' | ';') | block
tparams: 'G<' tparam (',' tparam)* 'G>'
tparam: annotation* NAME ['extends' type ('&' type)*]
types: type (',' type)*
type: annotation* simple_type
simple_type: (PRIMITIVE | NAME [targs] ('.' NAME [targs])*) (annotation* '[]')*
targs: 'G<' [targ (',' targ)*] 'G>'
targ: type | annotation* '?' [('extends' | 'super') type]
params: param (',' param)*
param: (annotation | 'final')* simple_type ['...'] (NAME ['.' 'this'] | 'this') ('[]')*
block: '{' statement* '}'
statement: block | ';' | (annotation | 'final' | 'static' | MODIFIER)+ (type_decl | simple_type declarator (',' declarator)* ';') | type_decl
    | 'if' '(' expr ')' statement ['else' statement] | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';'
    | 'for' '(' for_head ')' statement | 'switch' switch_rest trailer* [binary+] [';'] | 'try' try_rest | 'return' [expr] ';' | 'throw' expr ';' | 'break' [NAME] ';' | 'continue' [NAME] ';'
    | 'synchronized' '(' expr ')' block | 'assert' expr [':' expr] ';' | YIELD expr ';' | expr [':' statement | declarator (',' declarator)* ';' | (',' expr)* ';']
for_head: (annotation | 'final')+ simple_type NAME for_rest | expr [NAME for_rest | (',' expr)* ';' [expr] ';' [exprs] | ':' expr] | ';' [expr] ';' [exprs]
for_rest: ':' expr | ('[]')* ['=' init] (',' declarator)* ';' [expr] ';' [exprs]
exprs: expr (',' expr)*
switch_rest: '(' expr ')' '{' switch_entry* '}'
switch_entry: 'case' case_label (',' case_label)* (':' | CASE_ARROW rule_body) | 'default' (':' | CASE_ARROW rule_body | '->' rule_body) | statement
case_label: expr [NAME] | 'default'
rule_body: block | 'throw' expr ';' | expr ';'
try_rest: '(' resource (';' resource)* [';'] ')' block catch* ['finally' block] | block (catch+ ['finally' block] | 'finally' block)
resource: (annotation | 'final')* expr [NAME '=' expr]
catch: 'catch' '(' (annotation | 'final')* type ('|' type)* NAME ')' block
expr: unary binary*
binary: ('+' | '-' | BINOP | '*' | '&' | '|' | '<') unary | '>' ['>' ['>']] ['>='] unary | 'instanceof' ['final'] simple_type [NAME | '(' [params] ')' [NAME]] | '?' expr ':' expr | ('=' | AUG) (expr | array_init)
unary: ('+' | '-' | '!' | '~' | '++' | '--' | cast)* primary trailer* 
cast: 'C(' type ('&' type)* ')'
primary: NAME ['->' lambda_body] | LITERAL | NUMBER | STRING | '(' expr ')' | 'L(' [lambda_params] ')' '->' lambda_body | 'this' | 'super' | 'new' creator | PRIMITIVE ('[]')* | 'void' | 'switch' switch_rest
lambda_params: lambda_param (',' lambda_param)*
lambda_param: (annotation | 'final')* simple_type ['...'] [NAME] ('[]')*
lambda_body: block | expr
creator: annotation* (PRIMITIVE | NAME [targs] ('.' NAME [targs])*) ('(' [args] ')' [class_body] | '[' expr ']' ('[' expr ']')* ('[]')* | ('[]')+ array_init)
args: expr (',' expr)*
trailer: '.' ([targs] (NAME | 'super') | 'this' | 'class' | 'new' creator) | '(' [args] ')' | '[' expr ']' | '[]' | '++' | '--' | targs | '::' (NAME | 'new')
"""


def script(types: bool) -> str:
    """ECMAScript module, with the type syntax of TypeScript where ``types``."""

    def ts(text: str) -> str:
        return text if types else ""

    colon = ts("[':' type]")
    generics = ts("[tparams]")
    words = " | ".join(f"'{w}'" for w in RESERVED)
    grammar = f"""
file: statement* END
statement: block | ';' | declaration | 'if' '(' comma ')' statement ['else' statement] | 'while' '(' comma ')' statement | 'do' statement 'while' '(' comma ')' [';']
    | 'for' ['await'] '(' for_head ')' statement | 'switch' '(' comma ')' '{{' ('case' comma ':' statement* | 'default' ':' statement*)* '}}'
    | 'try' block ('catch' ['(' binding {colon} ')'] block ['finally' block] | 'finally' block) | 'return' [comma] eos | 'throw' comma eos | 'break' [NAME] eos | 'continue' [NAME] eos
    | 'debugger' eos | 'import' import_rest | 'export' export_rest | LABEL ':' statement | comma eos
declaration: variables eos | named_function | 'async' named_function | named_class {ts("| 'type' name [tparams] '=' type eos | 'interface' name [tparams] ['extends' type (',' type)*] '{' [members] '}' | 'enum' name '{' [enum_member (',' enum_member)* [',']] '}' | ('namespace' | 'module') (STRING | name ('.' name)*) block | 'declare' declared | 'abstract' class | 'global' block")}
variables: ('let' | 'var') variable (',' variable)* | 'const' (variable (',' variable)* {ts("| 'enum' name '{' [enum_member (',' enum_member)* [',']] '}'")})
variable: binding {ts("['!']")} {colon} ['=' expr]
for_head: ';' [comma] ';' [comma] | ('const' | 'let' | 'var') binding {colon} (('of' | 'in') comma | ['=' expr] (',' variable)* ';' [comma] ';' [comma]) | forcomma ('of' comma | ';' [comma] ';' [comma])
forcomma: comma
named_function: 'function' ['*'] name signature {ts("(block | eos)") or 'block'}
function: 'function' ['*'] [name] signature {ts("(block | eos)") or 'block'}
signature: {generics} ('(' | 'A(') [params] ')' {ts("[':' returned]")}
decorated: ('@' unary)* class
named_class: ('@' unary)* 'class' name class_rest
class: 'class' [name] class_rest
class_rest: {generics} ['extends' unary {ts("")}] {ts("['implements' type (',' type)*]")} '{{' class_member* '}}'
class_member: ';' | ('@' unary)* 'static' block | ('@' unary)* (MODIFIER | 'readonly' | 'static' | 'async' | 'get' | 'set' | '*' {ts("| 'abstract' | 'declare'")})* (property {ts("['?' | '!']")} (signature {ts("(block | eos)") or 'block'} | {colon} ['=' expr] eos) )
property: name | STRING | NUMBER | PRIVATE | '[' expr {colon} ']' | {words}
params: param (',' param)* [',']
param: ('@' unary)* (MODIFIER | 'readonly')* ['...'] (binding | 'this') {ts("['?']")} {colon} ['=' expr]
binding: name | '{{' [bind_prop (',' bind_prop)* [',']] '}}' | '[' [','+] [bind_item (','+ bind_item)* [','+]] ']'
bind_prop: '...' binding | property [':' binding] ['=' expr]
bind_item: ['...'] binding ['=' expr]
import_rest: STRING [with] eos | '(' [args] ')' trailer* binary* eos | '.' NAME trailer* binary* eos | {ts("['type']")} (name [',' (names | '*' 'as' name)] | names | '*' 'as' name) 'from' STRING [with] eos
with: 'with' object
names: '{{' [spec (',' spec)* [',']] '}}'
spec: {ts("['type']")} (name | STRING | 'default') ['as' (name | 'default' | STRING)]
export_rest: 'default' (function | 'async' function | decorated {ts("| 'abstract' class")} | comma eos) | declaration | {ts("['type']")} names ['from' STRING] eos | '*' ['as' (name | STRING)] 'from' STRING eos {ts("| '=' comma eos")}
block: '{{' statement* '}}'
comma: expr (',' expr)*
expr: {generics} (arrow | unary binary*) | 'async' ({generics} arrow | function trailer* binary*)
arrow: 'A(' [params] ')' {ts("[':' returned]")} '=>' arrow_body | ARROW_NAME '=>' arrow_body
arrow_body: block | expr
binary: (BINOP | '+' | '-' | '*' | 'in' | '<' | '>' ['>' ['>']]) operand_or_arrow | ('=' | AUG) expr | '?' expr ':' expr {ts("| 'as' type | 'satisfies' type | '&' operand_or_arrow | '|' operand_or_arrow")}
operand_or_arrow: {generics} (unary | arrow)
unary: ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* primary trailer*
primary: name | NUMBER | STRING | TEMPLATE | REGEX | PRIVATE | LITERAL | 'this' | 'super' | '(' comma ')' | '[' [','+] [element (','+ element)* [','+]] ']' | object | function | decorated | 'new' creator | 'yield' ['*'] [expr] | 'import' ('(' [args] ')' | '.' NAME) {ts("| 'async' function")} | JSX
creator: '.' NAME | ['new'] primary ('.' (NAME | PRIVATE) | '[' comma ']')* {ts("[targs]")} ['(' [args] ')']
element: ['...'] expr
object: '{{' [object_item (',' object_item)* [',']] '}}'
object_item: '...' expr | ('async' | 'get' | 'set' | '*' | 'static')* property [signature block | ':' expr | '=' expr]
args: element (',' element)* [',']
trailer: '.' (NAME | PRIVATE) | '?.' (NAME | PRIVATE | '[' comma ']' | '(' [args] ')' | TEMPLATE) | '[' comma ']' | ('(' | 'A(') [args] ')' | TEMPLATE | '++' | '--' {ts("| '!' | targs")}
name: NAME | 'as' | 'of' | 'from' | 'satisfies'
"""
    if not types:
        return grammar.replace("eos", EOS)
    grammar += f"""
declared: variables eos | function | 'async' function | decorated | 'type' name [tparams] '=' type eos | 'interface' name [tparams] ['extends' type (',' type)*] '{{' [members] '}}' | ['abstract'] class | 'enum' name '{{' [enum_member (',' enum_member)* [',']] '}}' | ('namespace' | 'module') (STRING | name ('.' name)*) (block | eos) | 'global' block
enum_member: property ['=' expr]
tparams: 'G<' tparam (',' tparam)* [','] 'G>'
tparam: ['in'] type ['=' type]
targs: 'G<' type (',' type)* 'G>'
returned: ['asserts'] type ['is' type]
type: ['|' | '&'] prefixed (('|' | '&') prefixed)* ['extends' type ['?' type ':' type]]
prefixed: ('keyof' | 'typeof' | 'readonly' | 'unique' | 'infer')* simple ('[' [type] ']')*
simple: name ('.' NAME)* [targs] | STRING | TEMPLATE | NUMBER | '-' NUMBER | LITERAL | 'void' | 'this' | 'const' [name ('.' NAME)* [targs]] | '(' type ')' | [tparams] 'A(' [params] ')' '=>' returned | ['abstract'] 'new' [tparams] ('A(' | '(') [params] ')' '=>' type
    | '{{' [members] '}}' | '[' [tuple_item (',' tuple_item)* [',']] ']' | 'import' '(' STRING ')' ('.' NAME)* [targs]
tuple_item: ['...'] type ['?'] [':' type]
members: member ((eos | ',') [member])*
member: ('+' | '-' | 'readonly' | 'get' | 'set' | MODIFIER)* (member_name ['?' | '-' '?' | '+' '?'] [callable | ':' type] | callable | 'new' callable)
member_name: NAME | 'as' | 'of' | 'from' | STRING | NUMBER | PRIVATE | {words} | '[' unary [':' type | 'in' type ['as' type]] ']'
callable: [tparams] ('(' | 'A(') [params] ')' [':' returned]
"""
    return grammar.replace("eos", EOS)


#: End of a statement: written, or put in at a line end, before a closing brace or at the end of the text.
EOS = "(';' | ASI)"
RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with yield let await"
).split()
