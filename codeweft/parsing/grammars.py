"""Grammars of Python 3.13, ECMAScript 2022, C11 and C++17 in the notation of `derivatives`.

C and C++ are parsed without a symbol table, so a name may be a type wherever one could stand. What begins alike inside
brackets is factored, or every level of nesting would double the summands.
"""

PYTHON = r"""
file: stmt*
stmt: simple_line | compound
simple_line: simple (';' simple)* ';'? NEWLINE
simple: (targets '=')+ (star_exprs | yield_expr) | target augment (star_exprs | yield_expr) | anntarget ':' expr ('=' (star_exprs | yield_expr))? | star_exprs | yield_expr | 'del' deltarget (',' deltarget)* ','? | 'pass' | 'break' | 'continue' | 'return' star_exprs? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') name (',' name)* | 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' ('.' | '...')* dotted 'import' imported | 'from' ('.' | '...')+ 'import' imported | 'assert' expr (',' expr)? | 'type' name typeparams? '=' expr
imported: '*' | alias (',' alias)* | '(' alias (',' alias)* ','? ')'
alias: name ('as' name)?
dotted: name ('.' name)*
name: NAME | 'match' | 'case' | 'type' | '_'
augment: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
targets: startarget (',' startarget)* ','?
startarget: '*'? target
target: single | '(' targets? ')' | '[' targets? ']'
single: name | atom trailer* final
final: '.' name | '[' slices ']'
anntarget: single | '(' single ')'
deltarget: single | '(' (deltarget (',' deltarget)* ','?)? ')' | '[' (deltarget (',' deltarget)* ','?)? ']'
star_exprs: star_expr (',' star_expr)* ','?
star_expr: expr | '*' bitor
named: name ':=' expr | expr
star_named: named | '*' bitor
yield_expr: 'yield' ('from' expr | star_exprs)?
expr: disj ('if' disj 'else' expr)? | 'lambda' lambdaparams? ':' expr
disj: conj ('or' conj)*
conj: inv ('and' inv)*
inv: 'not' inv | bitor (compare bitor)*
compare: '==' | '!=' | '<' | '<=' | '>' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not'
bitor: unary (binary unary)*
binary: '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@'
unary: ('+' | '-' | '~') unary | 'await'? atom trailer* ('**' unary)?
trailer: final | '(' args? ')'
atom: name | NUMBER | (STRING | fstring)+ | '(' (yield_expr | items)? ')' | '[' items? ']' | '{' (expr (':' expr (comp | morepairs) | comp | more) | name ':=' expr (comp | more) | '*' bitor more | '**' bitor morepairs)? '}' | '...' | 'True' | 'False' | 'None'
items: named (comp | more) | '*' bitor more
more: (',' star_named)* ','?
morepairs: (',' pair)* ','?
pair: expr ':' expr | '**' bitor
fstring: FSTART field* FEND
field: FOPEN (yield_expr | star_exprs) FEQ? FCONV? (FCOLON field*)? FCLOSE
comp: ('async'? 'for' targets 'in' disj ('if' cond)*)+
cond: disj | name ':=' expr
args: posarg (',' posarg)* (',' kwargs)? ','? | kwargs ','?
posarg: named comp? | '*' expr
kwargs: kwarg (',' kwarg)* (',' dictarg (',' dictarg)*)? | dictarg (',' dictarg)*
kwarg: name '=' expr | '*' expr
dictarg: name '=' expr | '**' expr
slices: slice (',' slice)* ','?
slice: named (':' expr? (':' expr?)?)? | ':' expr? (':' expr?)? | '*' bitor
params: plain (',' plain)* (',' '/')? (',' defaulted)? ','? | defaulted ','?
plain: name (':' expr)?
defaulted: plain '=' expr (',' (plain '=' expr | '/'))* (',' starred)? | starred
starred: '*' name (':' star_expr)? (',' kwonly)* (',' '**' plain)? | '*' (',' kwonly)+ (',' '**' plain)? | '**' plain
kwonly: plain ('=' expr)?
lambdaparams: name (',' name)* (',' '/')? (',' ldefaulted)? ','? | ldefaulted ','?
ldefaulted: name '=' expr (',' (name '=' expr | '/'))* (',' lstarred)? | lstarred
lstarred: '*' name (',' lkwonly)* (',' '**' name)? | '*' (',' lkwonly)+ (',' '**' name)? | '**' name
lkwonly: name ('=' expr)?
block: NEWLINE INDENT stmt+ DEDENT | simple_line
compound: 'if' named ':' block elif_ | 'while' named ':' block else_? | 'async'? 'for' targets 'in' star_exprs ':' block else_? | 'try' ':' block (except_+ else_? finally_? | finally_) | 'async'? 'with' withitems ':' block | decorator* ('async'? def_ | class_) | 'match' subject ':' NEWLINE INDENT case_+ DEDENT
elif_: ('elif' named ':' block elif_ | else_)?
else_: 'else' ':' block
finally_: 'finally' ':' block
except_: 'except' '*'? (expr ('as' name)?)? ':' block
withitems: withitem (',' withitem)* | '(' withitem (',' withitem)* ','? ')'
withitem: expr ('as' startarget)?
decorator: '@' named NEWLINE
def_: 'def' name typeparams? '(' params? ')' ('->' expr)? ':' block
class_: 'class' name typeparams? ('(' args? ')')? ':' block
typeparams: '[' typeparam (',' typeparam)* ','? ']'
typeparam: ('*' | '**')? name (':' expr)? ('=' star_expr)?
subject: star_named (',' star_named)* ','?
case_: 'case' patterns ('if' named)? ':' block
patterns: pattern (',' pattern)* ','?
pattern: closed ('|' closed)* ('as' name)? | '*' name
closed: name ('.' name)* ('(' (patarg (',' patarg)* ','?)? ')')? | '-'? NUMBER (('+' | '-') NUMBER)? | (STRING | fstring)+ | 'True' | 'False' | 'None' | '(' patterns? ')' | '[' patterns? ']' | '{' (patpair (',' patpair)* ','?)? '}'
patarg: pattern | name '=' pattern
patpair: closed ':' pattern | '**' name
"""

JAVASCRIPT = r"""
program: item*
item: stmt | 'import' (STRING | importclause 'from' STRING) semi | 'export' ('*' ('as' idname)? 'from' STRING semi | '{' (spec (',' spec)* ','?)? '}' ('from' STRING)? semi | decl | 'default' (fndecl | anonfn | classdecl | assign_ns semi))
importclause: ident (',' ('*' 'as' ident | named))? | '*' 'as' ident | named
named: '{' (spec (',' spec)* ','?)? '}'
spec: (idname | STRING) ('as' (idname | STRING))?
semi: ';' | ASI
decl: ('let' | 'var') vardef (',' vardef)* semi | 'const' constdef (',' constdef)* semi | fndecl | classdecl
vardef: ident ('=' assign)? | patt '=' assign
constdef: bind '=' assign
stmt: decl | blk | ';' | expr_ns semi | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' (';' | ASI)? | 'for' 'await'? '(' forhead ')' stmt | ('continue' | 'break') ident? semi | 'return' expr? semi | 'throw' expr semi | 'try' blk ('catch' ('(' bind ')')? blk ('finally' blk)? | 'finally' blk) | 'switch' '(' expr ')' '{' ('case' expr ':' stmt* | 'default' ':' stmt*)* '}' | ident ':' stmt | 'with' '(' expr ')' stmt | 'debugger' semi
forhead: (('let' | 'var') vardef (',' vardef)* | 'const' constdef (',' constdef)* | expr)? ';' expr? ';' expr? | (('let' | 'var' | 'const') bind | left) ('in' expr | 'of' assign)
blk: '{' stmt* '}'
fndecl: 'async'? 'function' '*'? ident fnrest
anonfn: 'async'? 'function' '*'? fnrest
fnrest: '(' params ')' '{' stmt* '}'
params: (param (',' param)* ','?)?
param: bind ('=' assign)? | '...' bind
bind: ident | patt
patt: '{' (bindprop (',' bindprop)* ','?)? '}' | '[' bindelem? (',' bindelem?)* ']'
bindprop: ident ('=' assign)? | propname ':' bind ('=' assign)? | '...' bind
bindelem: bind ('=' assign)? | '...' bind
ident: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let'
idname: ident | KEYWORD | 'await' | 'yield' | 'import' | 'export' | 'default' | 'var' | 'const' | 'if' | 'else' | 'while' | 'do' | 'for' | 'continue' | 'break' | 'return' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'with' | 'debugger' | 'function' | 'class' | 'extends' | 'new' | 'delete' | 'void' | 'typeof' | 'instanceof' | 'in' | 'this' | 'super' | 'null' | 'true' | 'false' | 'enum'
propname: idname | STRING | NUMBER | '[' assign ']'
expr: assign (',' assign)*
assign: left (assignop assign | ('++' | '--')? operated) | prefixed operated | PRIVATE 'in' un operated | 'async'? arrowhead '=>' arrowbody | 'yield' ('*'? assign)?
operated: (binop un)* ('?' assign ':' assign)?
arrowhead: ident | '(' params ')'
arrowbody: '{' stmt* '}' | assign_nb
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
binop: '??' | '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | 'instanceof' | 'in' | '<<' | '>>' | '>>>' | '+' | '-' | '*' | '/' | '%' | '**'
prefixed: ('delete' | 'void' | 'typeof' | '+' | '-' | '~' | '!' | 'await' | '++' | '--' | PREINC) un
un: prefixed | left ('++' | '--')?
left: prim tail* | newx tail*
newx: 'new' (newx | prim newtail*) arglist? | 'new' '.' NAME
newtail: '.' (idname | PRIVATE) | '[' expr ']' | template
tail: '.' (idname | PRIVATE) | '?.' (idname | PRIVATE | '[' expr ']' | arglist) | '[' expr ']' | arglist | template
arglist: '(' (arg (',' arg)* ','?)? ')'
arg: '...'? assign
prim: ident | NUMBER | STRING | REGEX | template | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' elem? (',' elem?)* ']' | obj | fndecl | anonfn | classexpr | 'import' '(' assign ')' | 'import' '.' NAME
elem: '...'? assign
template: TSTRING | THEAD expr (TMID expr)* TTAIL
obj: '{' (prop (',' prop)* ','?)? '}'
prop: ident ('=' assign)? | propname ':' assign | '...' assign | method
method: ('async'? '*'? | 'get' | 'set') propname fnrest
classdecl: 'class' ident classrest
classexpr: 'class' ident? classrest
classrest: ('extends' left)? '{' member* '}'
member: ';' | 'static'? (cmethod | cname ('=' assign)? semi) | 'static' blk
cmethod: ('async'? '*'? | 'get' | 'set') cname fnrest
cname: propname | PRIVATE
"""
JAVASCRIPT_SPINE = ["expr", "assign", "left", "prim", "obj", "fndecl", "anonfn", "classexpr"]

_C_EXPR = r"""
expr: assign (',' assign)*
assign: cond (assignop (assign | braces))?
assignop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '<<=' | '&=' | '|=' | '^=' | '>>='
cond: cast (binop cast)* ('?' expr? ':' cond)?
"""

C = (
    r"""
unit: ext*
ext: specs declarator blk | declaration | ';' | 'asm' '(' STRING+ ')' ';'
declaration: specs (initdecl (',' initdecl)*)? ';' | '_Static_assert' '(' cond (',' STRING+)? ')' ';'
initdecl: declarator attr* ('=' init)?
init: assign | braces
braces: '{' (initelem (',' initelem)* ','?)? '}'
initelem: (('[' cond ']' | '.' NAME)+ '=')? init
specs: lead* typecore follow*
lead: storage | qual
follow: storage | qual
storage: 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | '_Noreturn' | '_Thread_local' | '_Alignas' '(' (typename | cond) ')' | attr
qual: 'const' | 'volatile' | 'restrict' | '_Atomic'
attr: '__attribute__' '(' '(' attrbody* ')' ')'
attrbody: NAME | ',' | NUMBER | STRING | 'const' | '(' attrbody* ')'
typecore: base (follow* base)* | NAME | ('struct' | 'union') attr* (NAME? '{' structdecl* '}' | NAME) | 'enum' (NAME? '{' enumerator (',' enumerator)* ','? '}' | NAME) | 'typeof' '(' (typename | expr) ')'
base: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex'
enumerator: NAME ('=' cond)?
structdecl: specs (structdeclr (',' structdeclr)*)? ';' | ';'
structdeclr: declarator (':' cond)? | ':' cond
declarator: '*' qual* declarator | NAME suffix* | '(' attr* declarator ')' suffix*
suffix: '[' ('static' | qual)* (assign | '*')? ']' | '(' (paramlist | NAME (',' NAME)*)? ')'
paramlist: param (',' param)* (',' '...')?
param: specs (declarator | abstract)?
abstract: '*' qual* abstract? | absdirect
absdirect: '(' abstract ')' abssuffix* | abssuffix+
abssuffix: '[' ('static' | qual)* (assign | '*')? ']' | '(' paramlist? ')'
typename: qual* typecore qual* abstract?
blk: '{' (declaration | stmt)* '}'
stmt: blk | expr? ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (declaration | expr? ';') expr? ';' expr? ')' stmt | 'switch' '(' expr ')' stmt | 'case' cond ('...' cond)? ':' stmt | 'default' ':' stmt | NAME ':' stmt | 'goto' NAME ';' | ('break' | 'continue') ';' | 'return' expr? ';' | 'asm' 'volatile'? '(' asmbody* ')' ';'
asmbody: STRING | ':' | ',' | '[' NAME ']' | '(' expr ')'
"""
    + _C_EXPR
    + r"""
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '+' | '-' | '*' | '/' | '%'
cast: '(' typename ')' (cast | braces tail*) | unary
unary: ('++' | '--') unary | ('&' | '*' | '+' | '-' | '~' | '!' | '&&') cast | 'sizeof' (unary | '(' typename ')') | '_Alignof' '(' typename ')' | prim tail*
tail: '[' expr ']' | '(' (assign (',' assign)*)? ')' | '.' NAME | '->' NAME | '++' | '--'
prim: NAME | NUMBER | CHAR | STRING (STRING | NAME)* | '(' expr ')' | '(' blk ')' | '_Generic' '(' assign (',' (typename | 'default') ':' assign)+ ')'
"""
)

CPP = (
    r"""
unit: ext*
ext: function | declaration | ';' | template ext | 'namespace' attr* (NAME ('::' NAME)*)? '{' ext* '}' | 'inline' 'namespace' NAME '{' ext* '}' | 'extern' STRING ('{' ext* '}' | ext) | 'template' ext | 'asm' '(' STRING+ ')' ';'
template: 'template' '<' (tparam (',' tparam)*)? '>'
tparam: ('class' | 'typename') '...'? NAME? ('=' typeid)? | template 'class' '...'? NAME? ('=' qname)? | specs (declarator | abstract)? ('=' addx)?
function: specs declarator trailer body | lead* special trailer body
special: scope? '~'? NAME suffixf | scope? 'operator' convtype suffixf
convtype: specs ('*' | '&')*
trailer: ('const' | 'volatile' | '&' | '&&' | 'noexcept' ('(' cond ')')? | 'override' | 'final' | 'throw' '(' (typeid (',' typeid)*)? ')' | attr)* ('->' typeid)?
body: (':' meminit (',' meminit)*)? blk | 'try' (':' meminit (',' meminit)*)? blk handler+ | '=' ('default' | 'delete') ';'
meminit: qname ('(' (initarg (',' initarg)*)? ')' | braces) '...'?
declaration: specs (initdecl (',' initdecl)*)? ';' | 'static_assert' '(' cond (',' STRING+)? ')' ';' | 'using' 'namespace' qname ';' | 'using' 'typename'? qname (',' qname)* ';' | 'using' NAME attr* '=' typeid ';' | 'namespace' NAME '=' qname ';' | lead* special trailer ('=' (NUMBER | 'default' | 'delete'))? ';' | attr+ ';' | specs '&'? '&'? '[' NAME (',' NAME)* ']' ('=' assign | braces | '(' assign ')') ';'
initdecl: declarator trailer ('=' init | '=' ('default' | 'delete') | braces | '(' (initarg (',' initarg)*)? ')')?
init: assign | braces
initarg: init '...'?
braces: '{' (initelem (',' initelem)* ','?)? '}'
initelem: ('.' NAME '=')? initarg
specs: lead* typecore lead*
lead: 'typedef' | 'extern' | 'static' | 'thread_local' | 'mutable' | 'register' | 'inline' | 'virtual' | 'explicit' | 'constexpr' | 'friend' | 'const' | 'volatile' | 'alignas' '(' (typeid | cond) ')' | attr
attr: '[' '[' (attrbody)* ']' ']' | '__attribute__' '(' '(' attrbody* ')' ')'
attrbody: NAME | ',' | '::' | NUMBER | STRING | 'const' | '(' attrbody* ')'
typecore: base (lead* base)* | qname | 'typename' qname | 'auto' | 'decltype' '(' (expr | 'auto') ')' | ('class' | 'struct' | 'union') attr* (qname ('final')?)? ((':' basespec (',' basespec)*)? '{' member* '}') | ('class' | 'struct' | 'union') qname | 'enum' ('class' | 'struct')? (NAME? (':' specs)? '{' (enumerator (',' enumerator)* ','?)? '}' | qname (':' specs)?)
base: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool' | 'wchar_t' | 'char16_t' | 'char32_t'
enumerator: NAME ('=' cond)?
basespec: ('virtual' | 'public' | 'private' | 'protected')* qname '...'?
member: ('public' | 'private' | 'protected') ':' | function | memberdecl | template member | ';'
memberdecl: declaration | specs memdeclr (',' memdeclr)* ';'
memdeclr: declarator? ':' cond
qname: '::'? part ('::' 'template'? part)*
part: NAME targs? | 'std_name'
targs: '<' (targ (',' targ)*)? '>'
targ: typeid '...'? | addx '...'?
scope: '::'? (NAME targs? '::')+
declarator: ('*' | '&' | '&&' | scope '*') ('const' | 'volatile')* declarator | '...'? declid suffix* | '(' declarator ')' suffix*
declid: qname | scope? 'operator' opname | scope? '~' NAME
opname: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '>' '>=' | '<<=' | '==' | '!=' | '<=' | '>=' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | ('new' | 'delete') ('[' ']')? | STRING NAME
suffix: '[' cond? ']' attr* | suffixf
suffixf: '(' (param (',' param)* (',' '...')? | '...')? ')'
param: attr* specs (declarator | abstract)? ('=' init)?
abstract: ('*' | '&' | '&&' | scope '*') ('const' | 'volatile')* abstract? | '...' | absdirect
absdirect: '(' abstract ')' abssuffix* | abssuffix+
abssuffix: '[' cond? ']' | suffixf trailer
typeid: specs abstract?
blk: '{' stmt* '}'
stmt: attr* (blk | declaration | expr? ';' | 'if' 'constexpr'? '(' condition ')' stmt ('else' stmt)? | 'while' '(' condition ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (declaration | expr? ';') condition? ';' expr? ')' stmt | 'for' '(' rangedecl ':' init ')' stmt | 'switch' '(' condition ')' stmt | 'case' cond ('...' cond)? ':' stmt | 'default' ':' stmt | NAME ':' stmt | 'goto' NAME ';' | ('break' | 'continue') ';' | 'return' init? ';' | 'return' expr ';' | 'try' blk handler+)
rangedecl: specs (declarator | ('&' | '&&')? '[' NAME (',' NAME)* ']')
condition: (declaration | expr? ';')? (expr | specs declarator ('=' init | braces))
handler: 'catch' '(' (specs (declarator | abstract)? | '...') ')' blk
"""
    + _C_EXPR.replace("assign: cond", "assign: 'throw' assign? | cond")
    + r"""
addx: cast (addop cast)*
addop: '+' | '-' | '*' | '/' | '%' | '|' | '&' | '==' | '!=' | '&&' | '||'
binop: '||' | '&&' | '|' | '^' | '&' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '+' | '-' | '*' | '/' | '%' | '.*' | '->*'
cast: '(' typeid ')' cast | unary
unary: ('++' | '--') cast | ('&' | '*' | '+' | '-' | '~' | '!') cast | 'sizeof' (unary | '(' typeid ')' | '...' '(' NAME ')') | 'alignof' '(' typeid ')' | 'noexcept' '(' expr ')' | '::'? 'new' ('(' (initarg (',' initarg)*)? ')')? (newtype | '(' typeid ')') ('(' (initarg (',' initarg)*)? ')' | braces)? | '::'? 'delete' ('[' ']')? cast | prim tail*
newtype: specs ('*' | '&')* ('[' expr ']')*
tail: '[' (expr | braces) ']' | '(' (initarg (',' initarg)*)? ')' | braces | ('.' | '->') 'template'? (qname | '~' NAME | 'operator' opname) | '++' | '--'
prim: qname | NUMBER | CHAR | STRING (STRING | NAME)* | 'this' | 'true' | 'false' | 'nullptr' | '(' expr ')' | '(' fold ')' | scope? 'operator' opname | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') '<' typeid '>' '(' expr ')' | 'typeid' '(' (typeid | expr) ')' | base '(' (initarg (',' initarg)*)? ')' | base braces | lambda | 'typename' qname
fold: cast binop '...' (binop cast)? | '...' binop cast
lambda: '[' (capture (',' capture)*)? ']' ('<' (tparam (',' tparam)*)? '>')? ('(' (param (',' param)* (',' '...')? | '...')? ')' ('mutable' | 'constexpr' | 'noexcept' ('(' cond ')')? | attr)* ('->' typeid)?)? blk
capture: '&' | '=' | '&'? '...'? NAME '...'? ('=' init | braces)? | 'this' | '*' 'this'
"""
)
