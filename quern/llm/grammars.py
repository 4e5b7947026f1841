"""Grammars of eight languages in the notation of quern.llm.grammar."""

from __future__ import annotations

from functools import cache

from quern.functions.lexing import CLASSES, WORDS, Lexer
from quern.llm.grammar import Grammar

_ROUND = {"(": ")", "[": "]", "{": "}"}

PYTHON = r"""
name: NAME | 'match' | 'case' | 'type'
atom: name | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' inside ')' | '[' elements ']' | '{' entries '}'
trailer: '.' name | '(' arguments ')' | '[' subscript % ',' ','? ']'
term: ('+' | '-' | '~')* 'await'? atom trailer*
arith: term (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^') term)*
compared: 'not'* arith (('<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' 'not'?) arith)*
choice: compared (('and' | 'or') compared)*
plain: choice ('if' choice 'else' choice)?
lparam: '*' name | '**' name | '*' | '/' | name ('=' plain)?
lambda: 'lambda' (lparam % ',' ','?)? ':'
expr: lambda* choice ('if' choice 'else' lambda* choice)*
named: name ':=' expr | expr
starred: '*' arith | named
loops: ('async'? 'for' targets 'in' choice ('if' lambda* choice)*)+
inside: | yields | named loops | named (',' (starred % ',')? ','?)? | '*' arith ',' (starred % ',' ','?)?
elements: | named loops | starred % ',' ','?
entries: | expr ':' expr loops | (expr ':' expr | '**' arith) % ',' ','? | named loops | starred % ',' ','?
stop: ',' | $
arguments: named loops ','? | ((named | '*' expr) stop)* ((name '=' expr | '*' expr) stop)* ((name '=' expr | '**' expr) stop)*
subscript: expr? ':' expr? (':' expr?)? | starred
yields: 'yield' ('from' expr | values)?
values: ('*' arith | expr) % ',' ','?
target: name | atom trailer* ('.' name | '[' subscript % ',' ','? ']') | '(' targets? ')' | '[' targets? ']'
targets: ('*'? target) % ',' ','?
note: ':' expr
pplain: name note? stop
pdefault: name note? '=' expr stop
pstar: '*' name (':' '*'? expr)? stop (name note? ('=' expr)? stop)* | '*' ',' (name note? ('=' expr)? stop)+
parameters: (pplain* pdefault* | pplain+ pdefault* '/' stop pplain* pdefault* | pplain* pdefault+ '/' stop pdefault*) pstar? ('**' name note? stop)?
kinds: '[' (('*' | '**')? name (':' expr)? ('=' expr)?) % ',' ','? ']'
dotted: name % '.'
imported: name ('as' name)?
small: 'pass' | 'break' | 'continue' | 'return' values? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') name % ','
  | 'del' targets | 'assert' expr (',' expr)? | 'import' (dotted ('as' name)?) % ','
  | 'from' (('.' | '...')* dotted | ('.' | '...')+) 'import' ('*' | imported % ',' | '(' imported % ',' ','? ')')
  | 'type' name kinds? '=' expr
  | target ':' expr ('=' (yields | values))?
  | target ('+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=') (yields | values)
  | (targets '=')* (yields | values)
simple: small % ';' ';'? NL
suite: NL 'INDENT' statement* 'DEDENT' | 'INDENT' simple 'DEDENT'
pattern: pfirst ('|' pfirst)* ('as' name)?
pfirst: '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | dotted ('(' ((name '=' pattern | pattern) stop)* ')')? | '(' patterns? ')' | '[' patterns? ']' | '{' (('**' name | (STR+ | '-'? NUM (('+' | '-') NUM)? | dotted | 'None' | 'True' | 'False') ':' pattern) stop)* '}'
patterns: ('*' name | pattern) % ',' ','?
withs: (expr ('as' target)?) % ','
statement: 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)?
  | 'while' named ':' suite ('else' ':' suite)?
  | 'async'? 'for' targets 'in' values ':' suite ('else' ':' suite)?
  | 'try' ':' suite (('except' (expr ('as' name)?)? ':' suite)+ | ('except' '*' expr ('as' name)? ':' suite)+) ('else' ':' suite)? ('finally' ':' suite)?
  | 'try' ':' suite 'finally' ':' suite
  | 'async'? 'with' ('(' withs ','? ')' | withs) ':' suite
  | ('@' named NL)* ('async'? 'def' name kinds? '(' parameters ')' ('->' expr)? ':' suite | 'class' name kinds? ('(' arguments ')')? ':' suite)
  | 'match' values ':' NL 'INDENT' ('case' (patterns) ('if' named)? ':' suite)+ 'DEDENT'
  | simple
file: statement*
"""

_JS = r"""
key: word | STR | NUM | '[' expr ']'
atom: atom0 | '{' object '}' | function | class
atom0: name | NUM | STR | TPL | 'this' | 'super' | 'null' | 'true' | 'false' | 'new' '.' name | 'import' '.' name | 'import' | '(' seq ')' | '[' array ']'
unary: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | cast
op: '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '<' | '>' | '<=' | '>=' | '>' '>' '>'? | '==' | '!=' | '===' | '!==' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
trailer: '.' word | '?.' word | '?.'? targs '(' args ')' | '?.'? '[' seq ']' | targs TPL | bang
post: ('++' | '--')? typed
term: unary* atom trailer* post
bin: term % op
lasts: ('.' | '?.') word bang? | '[' seq ']' bang?
place: (name bang? | atom trailer* lasts | '[' array ']' | '{' object '}' | '(' seq ')') typed
assign: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>=' | '>' '>' '>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow: 'async'? (name | tparams '(' params ')' returns) '=>'
lead: place assign | arrow | 'yield' '*'? | 'await'
end: bin | arrow '{' block '}' | 'yield'
deepest: lead* end
deeper: (lead | bin '?' deepest ':')* end
deep: (lead | bin '?' deeper ':')* end
mid: (lead | bin '?' deep ':')* end
expr: (lead | bin '?' mid ':')* end
seq: expr % ','
term0: unary+ atom trailer* post | atom0 trailer* post
bin0: term0 | term0 op bin
place0: (name bang? | atom0 trailer* lasts | '[' array ']') typed
expr0: bin0 | place0 assign expr | bin0 '?' mid ':' expr | arrow ('{' block '}' | expr) | ('yield' '*'? | 'await') expr | 'yield'
seq0: expr0 (',' expr)*
array: (('...'? expr)? % ',')
args: (('...'? expr) % ',' ','?)?
body: NL? '{' block '}'
object: ((('...' expr | key ':' expr | name ('=' expr)? | ('async' | 'get' | 'set' | '*' | 'async' '*')? key tparams '(' params ')' returns body) % ',') ','?)?
function: 'async'? 'function' '*'? name? tparams '(' params ')' returns body
class: decorators abstract 'class' name? tparams ('extends' (atom0 | '{' object '}') trailer* targs)? implements NL? '{' members '}'
binding: name | '[' ('...'? binding0 ('=' expr)?)? % ',' ']' | '{' bindings '}'
binding0: name | '[' ('...'? binding0 ('=' expr)?)? % ',' ']' | '{' bindings '}'
bindings: ((('...' name | name ('=' expr)? | key ':' binding0 ('=' expr)?) % ',') ','?)?
param: decorators pmods '...'? (binding | self) optional note ('=' expr)?
params: (param % ',' ','?)?
decorators: ('@' name ('.' word)* (targs '(' args ')')? NL? | '@' '(' expr ')' NL?)*
member: decorators mmods* '*'? key optional tparams '(' params ')' returns (body | stop0) | 'static' body | decorators mmods* key sure note ('=' expr)? stop
stop: ';' | NL | $
members: (';' | NL | member | signature)*
label: name ':' NL?
head: 'for' 'await'? '(' forhead ')' NL? | 'while' '(' seq ')' NL? | 'with' '(' seq ')' NL? | label
ifhead: 'if' '(' seq ')' NL?
declarators: (binding sure note ('=' expr)?) % ','
vars: ('var' | 'let') declarators | 'const' (binding sure note '=' expr) % ',' | 'await'? 'using' (name note '=' expr) % ','
forhead: (vars | seq)? ';' seq? ';' seq? | ('var' | 'let' | 'const' | 'await'? 'using')? (binding | place) ('in' | 'of') seq
core: body | ';' | vars stop | seq0 stop | function | class | 'return' seq? stop | 'throw' seq stop | ('break' | 'continue') name? stop | 'debugger' stop
  | 'do' (body | seq0 stop | ';' ) NL? 'while' '(' seq ')' ';'?
  | 'try' body (NL? 'catch' ('(' binding note ')')? body)? NL? ('finally' body) | 'try' body NL? 'catch' ('(' binding note ')')? body
  | 'switch' '(' seq ')' NL? '{' (';' | NL)* (('case' seq | 'default') ':' statement*)* '}'
statement: NL | head* (core | ifhead (ifhead | head)* core (NL? 'else' NL? (ifhead | head)* core)*) | outer
block: statement*
specs: (((kind0 (word | STR) ('as' (word | STR))?) % ',') ','?)?
with0: (('with' | 'assert') '{' object '}')?
clause: name (',' ('*' 'as' name | '{' specs '}'))? | '*' 'as' name | '{' specs '}'
module: 'import' STR with0 stop | 'import' kind0 clause 'from' STR with0 stop
  | decorators 'export' (vars stop | function | class | 'default' (function | class | expr0 stop | ('{' object '}' | '[' array ']') typed stop) | kind0 '*' ('as' (word | STR))? 'from' STR with0 stop | kind0 '{' specs '}' ('from' STR with0)? stop | exported)
file: (statement | module)*
"""
JAVASCRIPT = _JS + r"""
name: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'using' | 'let' | 'as' | 'from' | 'yield' | 'await'
self: 'NEVER'
note:
sure:
optional:
returns:
targs:
tparams:
implements:
abstract:
pmods:
kind0:
bang: 'NEVER'
cast: 'NEVER'
typed:
mmods: 'static' | 'async' | 'get' | 'set' | 'accessor'
stop0: 'NEVER'
signature: 'NEVER'
outer: 'NEVER'
exported: 'NEVER'
"""
TYPESCRIPT = _JS + r"""
soft: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'using' | 'let' | 'as' | 'from' | 'abstract' | 'any' | 'asserts' | 'boolean' | 'declare' | 'implements' | 'infer' | 'interface' | 'is' | 'keyof' | 'module' | 'namespace' | 'never' | 'number' | 'object' | 'out' | 'override' | 'private' | 'protected' | 'public' | 'readonly' | 'require' | 'satisfies' | 'string' | 'symbol' | 'type' | 'unique' | 'unknown' | 'global' | 'accessor' | 'undefined' | 'bigint' | 'package' | 'await' | 'yield'
name: soft
inangle: soft | 'this' | 'null' | 'void' | 'true' | 'false' | 'typeof' | 'new' | 'extends' | 'in' | 'const' | 'import' | STR | NUM | TPL | '.' | ',' | '|' | '&' | '=>' | '?' | ':' | '=' | '-' | '...' | NL | '[' tuple ']' | '[' type? ']' | '{' members '}' | '(' params ')' | '(' type ')' | '<' | '>' | '(' args ')'
angle: '<' inangle* '>'
tpre: 'keyof' | 'typeof' | 'readonly' | 'unique' | 'infer' | 'asserts' | 'abstract' | 'new'
tatom: 'infer' soft ('extends' soft ('.' word | angle | '[' ']')*)? | soft | 'this' | 'null' | 'void' | 'true' | 'false' | '-'? NUM | STR | TPL | '(' type ')' | '[' tuple ']' | '{' members '}' | 'import' '(' args ')'
tunit: tpre* tatom ('.' word | angle | '[' type? ']')* (NL? 'is' tfun* tpre* tatom ('.' word | angle | '[' type? ']')*)?
tfun: ('new' | 'abstract')* tparams '(' params ')' '=>'
union: ('|' | '&')? (tfun* tunit) % ('|' | '&')
type2: (union 'extends' union '?' union ':')* union
type1: (union 'extends' (union | tfun+ type2) '?' type2 ':')* union
type: (union 'extends' (union | tfun+ type2) '?' type1 ':')* union
tuple: ((('...'? (soft '?'? ':')? '...'? type '?'?) % ',') ','?)?
self: 'this'
note: (':' type)?
sure: '!'? '?'?
optional: '?'?
returns: (':' type)?
targs: angle?
tparams: angle?
implements: ('implements' (soft ('.' word)* angle?) % ',')?
abstract: ('abstract' | 'declare')*
pmods: ('public' | 'private' | 'protected' | 'readonly' | 'override')*
kind0: 'type'?
bang: '!'
cast: angle
typed: (('as' | 'satisfies') ('const' | type))*
mmods: 'static' | 'async' | 'get' | 'set' | 'accessor' | 'public' | 'private' | 'protected' | 'readonly' | 'override' | 'abstract' | 'declare'
stop0: ';' | NL | ',' | $
sign: '+' | '-'
signature: (mmods* key '?'? note stop0) | mmods* key '?'? tparams '(' params ')' returns stop0 | tparams '(' params ')' returns stop0 | 'new' tparams '(' params ')' returns stop0
  | mmods* (sign? 'readonly')? '[' soft (':' type | 'in' type ('as' type)?) ']' (sign? '?')? note stop0
outer: 'declare'* (interface | 'const'? 'enum' name '{' (((key ('=' expr)?) % ',') ','?)? '}' | ('namespace' | 'module') (name ('.' name)* | STR) NL? ('{' inner* '}' | stop) | 'global' '{' inner* '}' | 'type' name tparams '=' NL? type stop
  | 'async'? 'function' '*'? name tparams '(' params ')' returns stop) | 'declare' (vars stop | 'const' declarators stop | function | class) | 'abstract' class
interface: 'interface' name tparams ('extends' (soft ('.' word)* angle?) % ',')? NL? '{' members '}'
inner: statement | module | 'const' declarators stop | 'import' 'type'? name '=' expr stop
exported: outer | 'const' declarators stop | 'as' 'namespace' name stop | '=' expr stop | 'import' name '=' expr stop | 'default' (interface | 'abstract' class | 'async'? 'function' name? tparams '(' params ')' returns stop)
file: inner*
"""

GO = r"""
name: NAME
prefix: '*' | '[' (expr | '...')? ']' | 'map' '[' type ']' | 'chan' '<-'? | '<-' 'chan' | 'func' '(' params ')'
base: name ('.' name)? ('[' type % ',' ','? ']')? | 'func' '(' params ')' ('(' params ')')? | 'struct' '{' fields '}' | 'interface' '{' methods '}' | '(' type ')'
type: prefix* base
result: '(' params ')' | type
param: name? '...'? type
params: (param % ',' ','?)?
function: 'func' '(' params ')' result? '{' block '}'
literal: ('[' (expr | '...')? ']' | 'map' '[' type ']') type | 'struct' '{' fields '}' | 'chan' '<-'? type | 'interface' '{' methods '}'
operand: name | NUM | STR | '(' expr ')' | '(' type ')' | literal | function
trailer: '.' name | '.' '(' (type | 'type') ')' | '[' index ']' | '(' arguments ')' | '{' elements '}'
index: (expr | type) % ',' ','? | expr? ':' expr? (':' expr)?
arguments: ((expr | type) % ',' '...'? ','?)?
unary: '+' | '-' | '!' | '^' | '*' | '&' | '<-'
op: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||'
expr: (unary* operand trailer*) % op
exprs: expr % ','
element: expr | '{' elements '}'
elements: ((element (':' element)?) % ',' ','?)?
assign: '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
simple: expr ('++' | '--')? | exprs assign exprs | expr '<-' expr
names: name % ','
varspec: names (type ('=' exprs)? | '=' exprs)
constspec: names (type? '=' exprs)?
typespec: name ('[' tparams ']')? '='? type
constraint: ('~'? type) % '|'
tparams: (name constraint? ) % ',' ','?
field: names type STR? | '*'? name ('.' name)? ('[' type % ',' ']')? STR?
fields: field? % ';'
methods: (name '(' params ')' result? | constraint)? % ';'
declaration: 'var' (varspec | '(' varspec? % ';' ')') | 'const' (constspec | '(' constspec? % ';' ')') | 'type' (typespec | '(' typespec? % ';' ')')
test: (simple? ';')? simple
body: '{' block '}'
statement: simple | declaration | body | 'return' exprs? | ('break' | 'continue') name? | 'goto' name | 'fallthrough' | ('go' | 'defer') expr
  | 'if' test body ('else' 'if' test body)* ('else' body)?
  | 'for' (expr | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr)? body
  | 'switch' (simple? ';')? simple? '{' (('case' (expr | type) % ',' | 'default') ':' block)* '}'
  | 'select' '{' (('case' simple | 'default') ':' block)* '}'
block: ((name ':')* statement?) % ';'
import: (name | '.')? STR
file: | 'package' name ';' ('import' (import | '(' import? % ';' ')') ';')* ((declaration | 'func' ('(' params ')')? name ('[' tparams ']')? '(' params ')' result? body?)? ';')*
"""
JAVA = r"""
name: NAME | 'record' | 'var' | 'yield' | 'sealed' | 'permits' | 'when' | 'non' | 'module'
prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
value: expr | '{' (value0 % ',')? ','? '}' | annotation
value0: expr | '{' (value0 % ',')? ','? '}' | annotation
annotation: '@' name ('.' name)* ('(' ((name '=' value1) % ',' | value1)? ')')?
value1: expr | '{' (value0 % ',')? ','? '}' | '@' name ('.' name)* ('(' ((name '=' value0) % ',' | value0)? ')')?
inangle: name | prim | '.' | ',' | '?' | 'extends' | 'super' | '&' | '[' ']' | '<' | '>' | annotation
angle: '<' inangle* '>'
class0: name angle? ('.' annotation* name angle?)*
type: annotation* (prim | class0) (annotation* '[' ']')*
dims: ('[' ']')*
creator: 'new' annotation* (class0 | prim) ('(' args ')' ('{' members '}')? | ('[' expr ']')+ dims | ('[' ']')+ '{' inits '}')
inits: ((expr | '{' inits '}') % ',')? ','?
args: (expr % ',')?
primary: name | NUM | STR | 'this' | 'super' | 'true' | 'false' | 'null' | '(' expr ')' | creator | type '.' 'class' | 'void' '.' 'class' | type '::' ('new' | name) | switch
trailer: '.' (angle? (name | 'this' | 'super') | 'class' | 'new' name angle? '(' args ')' ('{' members '}')?) | '(' args ')' | '[' expr ']' | '::' angle? (name | 'new')
cast: '(' type % '&' ')'
pattern: mods type name | type '(' (pattern0 % ',')? ')' name?
pattern0: mods type name | name | type '(' (pattern0 % ',')? ')' name?
term: ('+' | '-' | '!' | '~' | '++' | '--' | cast)* primary trailer* ('++' | '--')? ('instanceof' 'final'? (type | pattern))?
op: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' '>'? | '==' | '!=' | '<' | '<=' | '>' | '>=' | '&&' | '||'
bin: term % op
place: name | primary trailer* ('.' name | '[' expr ']') | '(' expr ')'
assign: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
arrow: cast? (name | '(' ((mods type '...'? name | name) % ',')? ')') '->'
lead: place assign | arrow
end: bin | arrow '{' block '}'
deepest: lead* end
deep: (lead | bin '?' deepest ':')* end
mid: (lead | bin '?' deep ':')* end
expr: (lead | bin '?' mid ':')* end
mods: ('public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'transient' | 'volatile' | 'strictfp' | 'synchronized' | 'default' | 'sealed' | 'non' '-' 'sealed' | annotation)*
declarators: (name dims ('=' (expr | '{' inits '}'))?) % ','
effect: place assign expr | ('++' | '--') term | primary trailer* ('(' args ')' | '++' | '--') | creator
body: '{' block '}'
head: 'for' '(' forhead ')' | 'while' '(' expr ')' | name ':'
ifhead: 'if' '(' expr ')'
forhead: (mods type declarators | effect % ',')? ';' expr? ';' (effect % ',')? | mods type name ':' expr
catch: 'catch' '(' mods type ('|' type)* name ')' body
label: 'case' (expr | pattern | 'default') % ',' ('when' expr)? | 'default'
switch: 'switch' '(' expr ')' '{' ((label ':')+ statement*)* '}' | 'switch' '(' expr ')' '{' (label '->' (expr ';' | body | 'throw' expr ';'))* '}'
core: body | ';' | mods type declarators ';' | kind | effect ';' | 'return' expr? ';' | 'throw' expr ';' | ('break' | 'continue') name? ';' | 'yield' expr ';' | 'assert' expr (':' expr)? ';'
  | 'do' (head* (body | effect ';')) 'while' '(' expr ')' ';' | 'try' body catch* ('finally' body) | 'try' body catch+ | 'try' '(' (mods type name '=' expr | place) % ';' ';'? ')' body catch* ('finally' body)?
  | switch | 'synchronized' '(' expr ')' body
statement: head* (core | ifhead (ifhead | head)* core ('else' (ifhead | head)* core)*)
block: statement*
throws: ('throws' type % ',')?
params: ((mods type annotation* '...'? (name | (name '.')? 'this') dims) % ',')?
kind: mods ('class' name angle? ('extends' type)? ('implements' type % ',')? ('permits' type % ',')? '{' members '}' | 'interface' name angle? ('extends' type % ',')? ('permits' type % ',')? '{' members '}'
  | '@' 'interface' name '{' members '}' | 'enum' name ('implements' type % ',')? '{' ((annotation* name ('(' args ')')? ('{' members '}')?) % ',')? ','? (';' member*)? '}'
  | 'record' name angle? '(' params ')' ('implements' type % ',')? '{' members '}')
member: ';' | kind | mods (body | angle? annotation* (type | 'void') name '(' params ')' dims throws (body | ';' | 'default' value ';') | angle? name '(' params ')' throws body | name body | type declarators ';')
members: member*
file: (annotation* 'package' name % '.' ';')? ('import' 'static'? name % '.' ('.' '*')? ';' | ';')* (kind | ';')*
"""
_C = r"""
qual: 'const' | 'volatile' | 'static' | 'extern' | 'inline' | 'register' | 'auto' | 'restrict' | '_Noreturn' | '_Thread_local' | '__extension__' | '__restrict' | '__inline' | '__inline__' | '__const' | '__volatile__' | '__restrict__' | 'typedef' | attr | moreq
attr: ('__attribute__' | '__attribute' | '_Alignas' | '__asm__' | 'asm' | '__asm') '(' ANY ')' | MACRO ('(' ANY ')')? | moreattr
prim: 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | '_Complex' | '__signed__' | moreprim
specs: qual* (prim (prim | qual)* | tag qual* | tname qual*)
dsuffix: '[' qual* expr? ']' | '(' params ')' after
declarator: pointer (dname | '(' declarator0 ')') dsuffix* attr*
declarator0: attr* pointer (dname | '(' declarator0 ')')? dsuffix*
init: '=' (expr | '{' inits '}') | moreinit
onedecl: declarator? ':' expr init? | declarator init?
declaration: specs (onedecl % ',')? ';'
desig: ('.' name | '[' expr ('...' expr)? ']')+ '=' | name ':'
inits: ((desig? (expr | '{' inits '}')) % ',')? ','?
abstract: ('*' qual* | moreptr)+ dsuffix* | '(' declarator0 ')' dsuffix* | dsuffix+
oneparam: specs pointer (declarator | abstract)? pdefault attr* | '...'
params: (oneparam % ',')? (',' '...')?
typename: specs abstract?
op: '+' | '-' | '*' | '/' | '%' | '<<' | '>' '>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | moreop
assign: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
string: MACRO* STR (STR | MACRO)*
primary: ename | NUM | string | '(' seq ')' | '(' typename ')' '{' inits '}' | '(' '{' block '}' ')' | ('sizeof' | '_Alignof' | '__typeof__' | 'typeof') '(' typename ')' | '_Generic' '(' ANY ')' | moreprimary
trailer: '.' dotname | '->' dotname | '[' seq ']' | '(' args ')' | moretrailer
unary: '+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'sizeof' | '__extension__' | '(' typename ')' | moreunary
term: unary* primary trailer* ('++' | '--')?
bin: term % op
args: ((expr | typename | morearg) % ',')?
place: unary* primary trailer* ('++' | '--')?
lead: place assign
end: bin | brace
deepest: lead* end
deep: (lead | bin '?' deepest? ':')* end
mid: (lead | bin '?' (deep % ',')? ':')* end
expr: (lead | bin '?' (mid % ',')? ':')* end moreend
seq: expr % ','
body: '{' block '}'
test: seq | moretest
head: 'for' '(' (declaration | seq? ';') test? ';' seq? ')' | 'while' '(' test ')' | 'switch' '(' test ')' | name ':' attr* | 'case' expr ('...' expr)? ':' | 'default' ':' | MACRO '(' ANY ')' | morehead
ifhead: 'if' moreif '(' test ')'
asm: ('asm' | '__asm__' | '__asm') ('volatile' | '__volatile__' | 'goto' | 'inline')* '(' ANY ')' ';'
core: body | ';' | seq ';' | declaration | 'return' (seq | '{' inits '}')? ';' | 'goto' '*'? expr ';' | ('break' | 'continue') ';' | 'do' (ifhead | head)* (body | seq ';' | ';') 'while' '(' seq ')' ';' | asm | MACRO ('(' ANY ')')? | morecore
statement: head* (core | $ | ifhead (ifhead | head)* core ('else' (ifhead | head)* core)*)
block: statement*
enums: ((attr* name attr* ('=' expr)?) % ',')? ','? MACRO*
fields: (declaration | ';' | MACRO ('(' ANY ')')? ';'? | ('_Static_assert' | '__extension__') ('(' ANY ')' ';')? | morefield)*
function: specs declarator declaration* morebody '{' block '}' moretail
outer: declaration | function | ';' | attr+ ';'? | 'extern' STR ('{' outer* '}' | declaration | function) | asm | '_Static_assert' '(' ANY ')' ';' | qual* NAME '(' ANY ')' ((declarator % ',')? ';' | declarator '{' block '}') | moreouter
file: outer*
"""
C = _C + r"""
name: NAME | MACRO
tname: name | MACRO '(' ANY ')' | 'typeof' '(' ANY ')' | '__typeof__' '(' ANY ')' | '_Atomic' '(' ANY ')'
dname: name
ename: name
dotname: name
tag: ('struct' | 'union') attr* name? '{' fields '}' | ('struct' | 'union') attr* name | 'enum' attr* name? '{' enums '}' | 'enum' attr* name
pointer: ('*' qual*)*
after:
moreq: '_Atomic'
moreattr: 'NEVER'
moreprim: 'NEVER'
moreinit: 'NEVER'
moreptr: 'NEVER'
pdefault:
moreop: 'NEVER'
moreprimary: 'NEVER'
moretrailer: 'NEVER'
moreunary: 'NEVER'
morearg: op | 'struct' | assign
moreend:
moretest: 'NEVER'
morehead: 'NEVER'
moreif:
brace: 'NEVER'
morecore: 'NEVER'
morefield: 'NEVER'
morebody:
moretail:
moreouter: 'NEVER'
"""
CPP = _C + r"""
name: NAME | MACRO | 'override' | 'final' | 'module' | 'import'
inangle: name | prim | NUM | STR | ',' | '::' | '*' | '&' | '&&' | '...' | '.' | '(' ANY ')' | '[' ANY ']' | '{' ANY '}' | '<' | '>' | '=' | '+' | '-' | '/' | '%' | '==' | '!=' | '!' | '~' | '||' | '|' | '<=' | '>=' | '->' | '?' | ':' | '<<' | 'const' | 'volatile' | 'typename' | 'class' | 'struct' | 'enum' | 'union' | 'auto' | 'true' | 'false' | 'nullptr' | 'decltype' | 'sizeof' | 'template' | 'noexcept' | 'this' | 'static_cast' | 'operator' | 'requires' | 'alignof' | 'new' | attr
angle: '<' inangle* '>'
qualified: '::'? (name angle? '::' 'template'?)* 
tname: MACRO '(' ANY ')' | 'typename'? '::'? ((name angle? '::' 'template'?)* name angle?) ('auto')? | ('decltype' | 'typeof' | '__typeof__') '(' ANY ')' ('::' name angle?)* | 'auto'
operators: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '~' | '!' | '=' | '<' | '>' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<<' | '>' '>' | '<<=' | '>' '>=' | '==' | '!=' | '<=' | '>=' | '<=>' | '&&' | '||' | '++' | '--' | ',' | '->*' | '->' | '(' ')' | '[' ']' | ('new' | 'delete') ('[' ']')? | STR name? | 'co_await' | specs pointer
operator: 'operator' operators
dname: '...'? qualified ('~'? name angle? | operator angle?)
ename: qualified ('~'? name angle? | operator angle?) | prim+ | 'typename' '::'? (name angle? '::' 'template'?)* name angle?
dotname: 'template'? qualified ('~' (name | prim) angle? | name angle? | operator)
tag: ('struct' | 'union' | 'class') attr* qualified name angle? 'final'? bases '{' fields '}' | ('struct' | 'union' | 'class') attr* bases '{' fields '}' | ('struct' | 'union' | 'class') attr* qualified name angle?
  | 'enum' ('class' | 'struct')? attr* (qualified name)? (':' specs)? '{' enums '}' | 'enum' ('class' | 'struct')? attr* qualified name (':' specs)?
bases: (':' ('public' | 'private' | 'protected' | 'virtual' | attr)* base0 (',' ('public' | 'private' | 'protected' | 'virtual' | attr)* base0)*)?
base0: 'typename'? qualified name angle? '...'? | 'decltype' '(' ANY ')'
pointer: ('*' qual* | '&' qual* | '&&' qual* | (name angle? '::')+ '*')* '...'?
after: ('const' | 'volatile' | '&' | '&&' | 'noexcept' ('(' ANY ')')? | 'throw' '(' ANY ')' | 'override' | 'final' | attr)* ('->' specs pointer dsuffix0?)? ('override' | 'final')* ('requires' requirement)?
dsuffix0: '(' params ')'
requirement: ('!'? (qualified name angle? ('(' ANY ')')? | '(' ANY ')' | 'requires' ('(' ANY ')')? '{' ANY '}' | 'true' | 'false')) % ('&&' | '||')
moreq: 'virtual' | 'explicit' ('(' ANY ')')? | 'constexpr' | 'consteval' | 'constinit' | 'friend' | 'mutable' | 'thread_local'
moreattr: '[' '[' ANY ']' ']' | 'alignas' '(' ANY ')'
moreprim: 'bool' | 'wchar_t' | 'char8_t' | 'char16_t' | 'char32_t'
moreinit: '{' inits '}' | '(' args ')' | '=' ('default' | 'delete')
moreptr: '&' qual* | '&&' qual* | '...'
pdefault: ('=' (expr | '{' inits '}'))?
moreop: '<=>' | '.*' | '->*' | 'and' | 'or'
lambda: '[' capture ']' angle? ('requires' requirement)? attr* ('(' params ')')? ('mutable' | 'constexpr' | 'noexcept' ('(' ANY ')')? | 'static' | attr)* ('->' specs pointer)? '{' block '}'
capture: (('&' | '=' | '*'? 'this' | '&'? '...'? name '...'? (('=' expr) | '{' inits '}' | '(' args ')')?) % ',')?
moreprimary: 'this' | 'true' | 'false' | 'nullptr' | lambda | qualified name angle? '{' inits '}' | prim+ '{' inits '}' | ('static_cast' | 'dynamic_cast' | 'const_cast' | 'reinterpret_cast') angle '(' seq ')'
  | 'typeid' '(' (seq | typename) ')' | ('sizeof' '...' | 'alignof' | 'noexcept' | 'decltype') '(' ANY ')' | 'typename' qualified name angle? ('(' args ')' | '{' inits '}')
  | '::'? 'new' ('(' args ')')? (specs ('*' qual*)* ('[' expr ']')* | '(' typename ')') ('(' args ')' | '{' inits '}')? | '(' fold ')' | 'requires' ('(' params ')')? '{' ANY '}' | 'throw'
fold: (expr | '...') (op | ',' | assign) ('...' | expr) ((op | ',' | assign) expr)?
moretrailer: '{' inits '}'
moreunary: '::'? 'delete' ('[' ']')? | 'throw' | 'co_await' | 'co_yield' | 'not'
morearg: '{' inits '}' | op | 'struct'
moreend: '...'?
moretest: specs pointer (dname | '[' name % ',' ']') (init | ':' expr) | declaration test2 | seq ';' seq
test2: seq | specs pointer dname init
morehead: 'for' '(' declaration? specs pointer (dname | '[' name % ',' ']') ':' (expr | '{' inits '}') ')' | attr
moreif: 'constexpr'?
brace: place '=' '{' inits '}'
catch: 'catch' '(' (specs pointer (declarator | abstract)? | '...') ')' body
morecore: 'try' body catch+ | 'using' (('namespace' | 'typename')? qualified name angle? | name attr* '=' typename | 'enum' qualified name) ';' | 'namespace' name '=' qualified name ';' | specs pointer '[' name % ',' ']' ('=' expr | '{' inits '}' | '(' args ')') ';'
  | 'static_assert' '(' ANY ')' ';' | ('co_return') (seq | '{' inits '}')? ';' | 'throw' seq? ';' | kindly
kindly: 'NEVER'
ctorinit: ':' (qualified name angle? ('(' args ')' | '{' inits '}') '...'?) % ','
template: ('template' angle ('requires' requirement)?)*
ctor: template qual* qualified '~'? name angle? '(' params ')' after (ctorinit? body catch* | 'try' ctorinit? body catch+ | ('=' ('default' | 'delete' | NUM))? ';')
conversion: template qual* qualified 'operator' specs pointer '(' ')' after (body | ('=' ('default' | 'delete' | NUM))? ';')
opfun: template specs pointer qualified 'operator' operators angle? '(' params ')' after (body | ('=' ('default' | 'delete' | NUM))? ';')
morefield: ('public' | 'private' | 'protected' | name) NAME? ':' | template (function ';'? | declaration) | ctor ';'? | conversion | opfun | template specs pointer dname '(' params ')' after '=' NUM ';' | 'friend' (('class' | 'struct')? qualified name angle? ';' | function | declaration) | 'using' ('typename'? qualified dotname | name attr* '=' typename | 'enum' qualified name) ';' | template 'using' name attr* '=' typename ';' | 'static_assert' '(' ANY ')' ';'
  | template 'concept' name '=' requirement ';'
morebody: ctorinit?
moretail: 
moreouter: 'inline'? 'namespace' attr* (name ('::' 'inline'? name)*)? attr* '{' outer* '}' | 'namespace' name '=' qualified name ';' | template (function | declaration) | ctor | conversion | opfun | 'extern'? 'template' declaration
  | 'extern'? 'template' (('class' | 'struct') qualified name angle? | specs declarator) ';' | 'using' (('namespace' | 'typename')? qualified dotname | name attr* '=' typename | 'enum' qualified name) ';' | template 'using' name attr* '=' typename ';' | 'static_assert' '(' ANY ')' ';' | template 'concept' name '=' requirement ';' | specs declarator 'try' ctorinit? body catch+
  | name angle '(' params ')' '->' specs pointer ';' | 'export'? ('module' | 'import') name ('.' name)* ';'
"""

RUBY = r"""
sep: NL | ';'
atom: NAME | NUM | SYM | STR+ | 'nil' | 'true' | 'false' | 'self' | 'super' | 'yield' | '__FILE__' | '__LINE__' | '__method__' | '(' statements ')' | '[' list ']' | '{' hash '}' | '->' ('(' params ')' | params)? ('{' block '}' | 'do' block 'end')
  | 'if' iffed 'end' | 'unless' unlessed 'end' | 'while' looped 'end' | 'until' looped 'end' | 'for' forbody 'end' | 'case' cases 'end' | 'begin' bodied 'end' | 'DEF' definition 'end' | 'class' classbody 'end' | 'module' modulebody 'end' | 'EDEF' ('(' params ')')? '=' command | '::' NAME
trailer: ('.' | '&.') NAME | '.' '(' arguments ')' | '::' NAME | '(' arguments ')' | '[' list ']' | '{' block '}' | 'do' block 'end'
unary: '!' | '-' | '+' | '~' | 'not' | 'defined?' | '..' | '...'
op: '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>>' | '&' | '|' | '^' | '==' | '!=' | '===' | '=~' | '!~' | '<' | '>' | '<=' | '>=' | '<=>' | '&&' | '||' | '..' | '...'
term: unary* atom trailer*
bin: term % op ('..' | '...')?
place: NAME | '::' NAME | atom trailer* (('.' | '&.') NAME | '::' NAME | '[' list ']')
assign: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '&=' | '|=' | '^=' | '&&=' | '||='
ternary: '?' | NL? '?'
deep: ((unary* place assign) | bin '?' bin ':')* bin
mid: ((unary* place assign) | bin '?' deep ':')* bin
expr: ((unary* place assign) | bin '?' (mid ':' | SYM))* bin ('rescue_mod' bin)?
argument: ('*' | '**' | '&')? expr | LABEL NL? expr? | expr '=>' NL? expr | '...' | '&' | '*' | '**'
arglist: argument % ','
callee: unary* (NAME | 'super' | 'yield' | atom trailer* ('.' | '&.' | '::') NAME)
command: (unary* place assign)* ((callee+ arglist | expr) ('do' block 'end' (('.' | '&.') NAME ('(' arguments ')')? ('{' block '}' | 'do' block 'end')?)*)?)
arguments: NL? (arglist ','? | command)? NL?
list: NL? (arglist ','?)? NL?
hash: NL? (((LABEL NL? expr? | expr '=>' NL? expr | '**' expr) NL?) % ',' ','?)? NL?
pname: NAME | '(' pnames ')'
pnames: ('*'? pname? ) % ','
parameter: '*' NAME? | '**' (NAME | 'nil')? | '&' NAME? | '...' | NAME ('=' expr)? | LABEL NL? expr? | '(' pnames ')'
params: NL? (parameter % ',' ','?)? (';' NAME % ',')? NL?
bar: '|' params '|' | '||'
jump: ('return' | 'break' | 'next') (arglist | command)?
whole: jump | command | (('*'? place | '(' pnames ')' | '*') % ',') ','? '=' (arglist | command) | 'alias' (NAME | SYM | word) (NAME | SYM | word) | 'undef' (NAME | SYM) % ',' | 'redo' | 'retry' | ('BEGIN' | 'END') '{' statements '}' | expr ('=>' | 'in') pattern
joined: ('not' | '!')? whole (('and' | 'or') 'not'? whole)*
statement: joined (('if_mod' | 'unless_mod' | 'while_mod' | 'until_mod' | 'rescue_mod') joined)*
statements: statement? % sep
then: sep* 'then' sep* | sep+
bodied: statements ('rescue' (arglist)? ('=>' place)? then statements)* ('else' statements)? ('ensure' statements)?
definition: ('(' params ')' sep? | parameter % ',' sep | sep) bodied
path: '::'? NAME ('::' NAME)*
classbody: (path ('<' expr)? | '<<' expr) sep bodied
modulebody: path sep statements
iffed: joined then statements ('elsif' joined then statements)* ('else' statements)?
unlessed: joined then statements ('else' statements)?
looped: joined then statements
forbody: (NAME | '(' pnames ')') % ',' 'in' expr then statements
pattern0: (('^' | '*' | '**')? (atom ('(' arguments ')' | '[' list ']' | '::' NAME)* | '{' ANY '}' | '[' ANY ']') (('..' | '...') NUM?)? | LABEL (atom | '{' ANY '}')?) % ('|' | '=>')
pattern: pattern0 % ',' ','?
cases: statement? sep* (('when' ('*'? expr) % ',' then statements)+ | ('in' pattern (('if_mod' | 'unless_mod') joined)? then statements)+) ('else' statements)?
block: bar? bodied
file: statements
"""

_TEXTS = {
    "python": (PYTHON, _ROUND | {"INDENT": "DEDENT"}, ("INDENT",)),
    "javascript": (JAVASCRIPT, _ROUND, ()),
    "typescript": (TYPESCRIPT, _ROUND, ()),
    "go": (GO, _ROUND, ()),
    "java": (JAVA, _ROUND, ()),
    "c": (C, _ROUND, ()),
    "cpp": (CPP, _ROUND, ()),
    "ruby": (RUBY, _ROUND | {w: "end" for w in ("if", "unless", "while", "until", "for", "case", "begin", "DEF", "class", "module", "do")}, ()),
}


@cache
def grammar(lang: str) -> Grammar:
    """The grammar of a language, made once per process."""
    text, brackets, unseen = _TEXTS[lang]
    return Grammar(text, "file", brackets, WORDS[lang].split(), CLASSES, unseen)


@cache
def lexer(lang: str) -> Lexer:
    """The lexer of a language for the characters of its grammar."""
    return Lexer(lang, grammar(lang).char)
