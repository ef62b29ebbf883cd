"""Grammars of the five languages over the token classes of the lexers.

Operators are kept flat (no precedence), since only acceptance matters. ``>`` is always a token by itself, so that it can close
type arguments; longer operators that begin with it are spelled out.
"""

from __future__ import annotations

from functools import cache

from palimpsest.llm.syntax.grammar import Grammar

RUST = """
shape: inner* item*
inner: '#' '!' '[' tree* ']'
attr: '#' '[' tree* ']'
tree: 'mt' | '(' tree* ')' | '[' tree* ']' | '{' tree* '}'
item: attr* vis? kind
vis: 'pub' ('(' ('crate' | 'self' | 'super' | 'in' simple) ')')?
simple: '::'? word ('::' word)*
word: 'id' | 'self' | 'Self' | 'super' | 'crate'
kind: 'use' usetree ';' | function | struct | enum | impl | trait | constant | static | alias | module | foreign
kind: call ';'? | simple '!' 'id' '{' tree* '}' | simple '!' 'id' '(' tree* ')' ';'
usetree: '::'? (word '::')* (word ('as' ('id' | '_'))? | '*' | '{' (usetree (',' usetree)* ','?)? '}')
function: ('const' | 'async' | 'unsafe' | 'default' | 'extern' 'str'?)* 'fn' 'id' generics? '(' params ')' ('->' type)? where? (block | ';')
generics: '<' (gparam (',' gparam)* ','?)? '>'
gparam: attr* ('life' (':' ('life' ('+' 'life')*)?)? | 'id' (':' bounds?)? ('=' type)? | 'const' 'id' ':' type ('=' expr)?)
params: (param (',' param)* ','?)?
param: attr* (('&' 'life'?)? 'mut'? 'self' (':' type)? | pattern ':' type | '...' | type)
type: typepath | '&' 'life'? 'mut'? type | '&&' 'life'? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']'
type: '(' (type (',' type)* ','?)? ')' | '!' | '_' | ('for' generics)? ('unsafe' | 'extern' 'str'?)* 'fn' '(' params ')' ('->' type)?
type: ('impl' | 'dyn') bounds | '<' type ('as' typepath)? '>' ('::' segment)+ | call
bounds: bound ('+' bound)* '+'?
bound: 'life' | '?'? ('for' generics)? typepath | '(' bound ')'
typepath: '::'? segment ('::' segment)*
segment: word ('::'? arguments | '(' (type (',' type)* ','?)? ')' ('->' type)?)?
arguments: '<' (argument (',' argument)* ','?)? '>'
argument: 'life' | type | 'id' arguments? '=' type | 'id' ':' bounds | literal | '-' 'num' | block
where: 'where' (wherepart (',' wherepart)* ','?)?
wherepart: 'life' ':' ('life' ('+' 'life')*)? | ('for' generics)? type ':' bounds?
struct: ('struct' | 'union') 'id' generics? (where? '{' fields '}' | '(' tuple ')' where? ';' | where? ';')
fields: (field (',' field)* ','?)?
field: attr* vis? 'id' ':' type
tuple: (attr* vis? type (',' attr* vis? type)* ','?)?
enum: 'enum' 'id' generics? where? '{' (variant (',' variant)* ','?)? '}'
variant: attr* vis? 'id' ('{' fields '}' | '(' tuple ')')? ('=' expr)?
impl: 'unsafe'? 'impl' generics? 'const'? '!'? type ('for' type)? where? '{' inner* member* '}'
member: attr* vis? 'default'? (function | constant | alias | call ';'?)
trait: 'unsafe'? 'auto'? 'trait' 'id' generics? (':' bounds?)? where? '{' inner* member* '}'
constant: 'const' ('id' | '_') ':' type ('=' expr)? ';'
static: 'static' 'mut'? 'id' ':' type ('=' expr)? ';'
alias: 'type' 'id' generics? (':' bounds)? where? ('=' type)? where? ';'
module: 'unsafe'? 'mod' 'id' (';' | '{' inner* item* '}')
foreign: 'extern' 'crate' word ('as' ('id' | '_'))? ';' | 'unsafe'? 'extern' 'str'? '{' inner* item* '}'
block: '{' inner* statement* expr? '}'
statement: ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | item | attr* expr ';' | attr* blocklike
blocklike: ('life' ':')? ('unsafe' | 'const')? block | 'async' 'move'? block | if | match | ('life' ':')? loop | simple '!' '{' tree* '}'
if: 'if' expr block ('else' (block | if))?
match: 'match' expr '{' inner* (arm* lastarm)? '}'
arm: attr* pattern ('if' expr)? '=>' (expr ',' | blocklike ','?)
lastarm: attr* pattern ('if' expr)? '=>' expr ','?
loop: 'while' expr block | 'for' pattern 'in' expr block | 'loop' block
expr: operand (binary operand)* | 'let' pattern '=' expr | range
range: operand (binary operand)* ('..' | '..=') (operand (binary operand)*)? | ('..' | '..=') (operand (binary operand)*)?
binary: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '<' '<' | '<' '<=' | '>' | '>' '=' | '>' '>' | '>' '>' '='
binary: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '>' '=='
operand: ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'? | '&' 'raw' ('const' | 'mut'))* postfix | 'let' pattern '=' operand
operand: ('-' | '!' | '*' | '&' | '&&')* closure
operand: 'return' expr? | 'break' 'life'? expr? | 'continue' 'life'? | 'yield' expr?
closure: 'for' generics closure | ('static' | 'async')* 'move'? ('|' (cparam (',' cparam)* ','?)? '|' | '||') (expr | '->' type block)
cparam: attr* simplepattern (':' type)?
postfix: primary (tail | 'as' type)*
tail: '?' | '.' ('id' ('::' arguments)? | 'num' | 'await' | 'self') | '(' exprs ')' | '[' expr ']'
primary: literal | path | path '{' (init (',' init)* ','?)? ('..' expr?)? '}' | path '{' (init ',')+ '..' expr '}' | '(' exprs ')'
primary: '[' exprs ']' | '[' expr ';' expr ']' | blocklike | call
exprs: (attr* expr (',' attr* expr)* ','?)?
init: attr* ('id' | 'num') (':' expr)?
path: '::'? pathword ('::' pathword)* | '<' type ('as' typepath)? '>' ('::' pathword)+
pathword: word ('::' arguments)?
call: simple '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}')
literal: 'num' | 'str' | 'char' | 'true' | 'false'
pattern: '|'? simplepattern ('|' simplepattern)*
simplepattern: '-'? literal | '-'? (literal | path) ('..=' | '..' | '...') ('-'? (literal | path))? | ('..' | '..=') ('-'? (literal | path))?
simplepattern: 'ref'? 'mut'? 'id' ('@' simplepattern)? | '_' | ('&' | '&&') 'mut'? simplepattern | '(' patterns ')' | '[' patterns ']'
simplepattern: path | path '(' patterns ')' | path '{' (fpattern (',' fpattern)* ','?)? '..'? '}' | path '{' (fpattern ',')+ '..' '}' | call | 'box' simplepattern
patterns: (pattern (',' pattern)* ','?)?
fpattern: attr* ('ref'? 'mut'? 'id' | ('id' | 'num') ':' pattern)
"""

SCRIPT = """
shape: full* bare?
Id: 'id' | 'async' | 'of' | 'get' | 'set' | 'static' | 'type' | 'interface' | 'readonly' | 'as' | 'from' | 'declare' | 'namespace' | 'abstract'
Id: 'keyof' | 'is' | 'infer' | 'satisfies' | 'asserts' | 'module' | 'private' | 'public' | 'protected' | 'implements' | 'let' | 'yield' | 'await'
Id: 'override' | 'accessor' | 'out'
Name: Id | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'enum' | 'export'
Name: 'extends' | 'false' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super'
Name: 'switch' | 'this' | 'throw' | 'true' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with'
full: 'if' '(' expr ')' bare 'else' full
full: ';' | block | declared | bare ';' | 'if' '(' expr ')' full ('else' full)? | loophead full | Id ':' full | try | switch
bare: variables | 'return' expr? | 'break' Id? | 'continue' Id? | 'throw' expr | expr | 'debugger' | imports | exports | 'do' full 'while' '(' expr ')'
bare: 'if' '(' expr ')' bare ('else' bare)? | 'if' '(' expr ')' full 'else' bare | loophead bare | Id ':' bare | tsbare
block: '{' full* bare? '}'
loophead: 'while' '(' expr ')' | 'for' 'await'? '(' forhead ')' | 'with' '(' expr ')'
forhead: (variables | expr)? ';' expr? ';' expr? | ('var' | 'let' | 'const') binding ann? ('of' | 'in') expr | left ('of' | 'in') expr
try: 'try' block ('catch' ('(' binding ann? ')')? block)? ('finally' block)?
switch: 'switch' '(' expr ')' '{' (('case' expr | 'default') ':' full* bare?)* '}'
declared: function | deco* class | 'export' deco* (function | class) | 'export' 'default' (function | class) | tsdeclared
variables: ('var' | 'let') variable (',' variable)* | 'const' constant (',' constant)*
constant: binding ann? '=' assign
variable: binding '!'? ann? ('=' assign)?
binding: Id | '{' (bprop (',' bprop)* ','?)? '}' | '[' ','* (bitem (','+ bitem)* ','*)? ']'
bprop: Id ('=' assign)? | pname ':' binding ('=' assign)? | '...' binding
bitem: '...'? binding ('=' assign)?
function: 'async'? 'function' '*'? Id? tparams? '(' params ')' ann? (block | nobody)
params: (param (',' param)* ','?)?
param: deco* modifier* '...'? (binding | 'this') '?'? ann? ('=' assign)?
deco: '@' left ';'?
class: tsabstract? 'class' Id? tparams? ('extends' left targs?)? impls? '{' member* last? '}'
member: ';' | deco* modifier* 'static' block | deco* (modifier | 'static')* method | deco* (modifier | 'static')* pname ('?' | '!')? ann? ('=' assign)? ';' | tsmember
last: deco* (modifier | 'static')* pname ('?' | '!')? ann? ('=' assign)? | tslast
method: ('async' | 'get' | 'set')? '*'? pname '?'? tparams? '(' params ')' ann? (block | nobody)
pname: Name | 'str' | 'num' | '[' assign ']' | 'private'
imports: 'import' tsonly? (Id (',' (named | '*' 'as' Id))? | named | '*' 'as' Id) 'from' 'str' attributes? | 'import' 'str' attributes?
named: '{' (ispec (',' ispec)* ','?)? '}'
ispec: tsonly? (Name | 'str') ('as' (Name | 'str'))?
attributes: 'with' object
exports: 'export' tsonly? (named ('from' 'str' attributes?)? | '*' ('as' (Name | 'str'))? 'from' 'str' attributes?) | 'export' variables | 'export' 'default' assign | tsexport
expr: assign (',' assign)*
assign: operand (binary operand)* ('?' assign ':' assign)? | arrow | 'yield' '*'? assign? | operand (binary operand)* '=' arrow | operand (binary operand)* ('||' | '??' | '&&') arrow
binary: '+' | '-' | '*' | '/' | '%' | '**' | '&' | '|' | '^' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '<<' | 'in' | 'instanceof'
binary: '>' | '>' '=' | '>' '>' | '>' '>' '>' | '>' '>' '=' | '>' '>' '>' '=' | '=' | 'assignop'
operand: ('!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--')* left ('++' | '--')? cast*
left: primary tail*
tail: '.' (Name | 'private') | '?.' (Name | 'private' | '[' expr ']' | args | template) | '[' expr ']' | args | template | tstail
args: '(' ('...'? assign (',' '...'? assign)* ','?)? ')'
primary: Id | 'this' | 'super' | 'num' | 'str' | 'regex' | 'true' | 'false' | 'null' | template | '(' expr ')' | array | object | function | deco* class
primary: 'new' (primary | 'new' '.' Name) (('.' (Name | 'private')) | '[' expr ']')* targs? args? | 'new' '.' Name | 'import' (args | '.' Name) | 'private'
array: '[' ','* ('...'? assign (','+ '...'? assign)* ','*)? ']'
object: '{' (prop (',' prop)* ','?)? '}'
prop: Id ('=' assign)? | pname ':' assign | '...' assign | method
template: 'tpl' | 'tpl{' expr ('tpl|' expr)* '}tpl'
arrow: 'async'? (Id | tparams? '(' params ')' ann?) '=>' (assign | block)
"""

TYPES = """
ann: ':' type | ':' 'asserts'? (Id | 'this') 'is' type | ':' 'asserts' (Id | 'this')
nobody: ';'
modifier: 'private' | 'public' | 'protected' | 'readonly' | 'abstract' | 'declare' | 'override' | 'accessor'
tsabstract: 'abstract'
tsonly: 'type'
tsmember: deco* (modifier | 'static')* '[' Id ':' type ']' ann ';'
tslast: deco* (modifier | 'static')* ('[' Id ':' type ']' ann | ('async' | 'get' | 'set')? '*'? pname '?'? tparams? '(' params ')' ann?)
cast: 'as' (type | 'const') | 'satisfies' type
tstail: '!' | targs args | targs template
impls: 'implements' type (',' type)*
tparams: '<' tparam (',' tparam)* ','? '>'
tparam: ('const' | 'in' | 'out' | 'in' 'out')? Id ('extends' type)? ('=' type)?
targs: '<' type (',' type)* ','? '>'
type: ('|' | '&')? unary (('|' | '&') unary)* | unary 'extends' type '?' type ':' type | tparams? '(' params ')' '=>' (type | ann2) | 'abstract'? 'new' tparams? '(' params ')' '=>' type
ann2: 'asserts'? (Id | 'this') 'is' type
unary: ('keyof' | 'readonly' | 'infer') unary | 'typeof' Name ('.' Name)* targs? | 'infer' Id 'extends' type | base ('[' type? ']')*
base: Id ('.' Name)* targs? | 'void' | 'null' | 'this' | 'true' | 'false' | 'str' | '-'? 'num' | ttemplate | '(' type ')' | '{' members '}' | '[' (titem (',' titem)* ','?)? ']' | 'import' '(' 'str' ')' ('.' Name)* targs?
titem: '...'? (Name '?'? ':')? type '?'?
ttemplate: 'tpl' | 'tpl{' type ('tpl|' type)* '}tpl'
members: (tmember (';' | ','))* tmember?
tmember: 'readonly'? pname '?'? ann? | ('get' | 'set')? pname '?'? tparams? '(' params ')' ann? | 'new'? tparams? '(' params ')' ann?
tmember: ('-' | '+')? 'readonly'? '[' Id (':' type | 'in' type ('as' type)?) ']' (('-' | '+')? '?')? ann?
tsdeclared: 'export'? 'default'? 'declare'? ('interface' Id tparams? ('extends' type (',' type)*)? '{' members '}' | 'const'? 'enum' Id '{' (eitem (',' eitem)* ','?)? '}')
tsdeclared: 'export'? 'declare'? ('namespace' | 'module') (Id ('.' Name)* | 'str') block | 'export'? 'declare' (function | class) | 'declare' 'id' block
eitem: pname ('=' assign)?
tsbare: 'export'? 'declare'? 'type' Id tparams? '=' type | 'export'? 'declare' ('var' | 'let' | 'const') variable (',' variable)* | 'import' Id '=' expr
tsexport: 'export' '=' expr | 'export' 'as' 'namespace' Id
"""

BASH = """
shape: gap* (list? end)* list?
gap: 'nl'
end: 'nl' | ';' 'nl'* | '&' 'nl'*
list: andor ((';' | '&' | 'nl') 'nl'* andor)* (';' | '&')? 'nl'*
andor: pipeline (('&&' | '||') 'nl'* pipeline)*
pipeline: ('!' | 'time')* command ('|' 'nl'* command)* | '!'
command: simple | compound redirect* | 'w' '(' ')' 'nl'* compound redirect* | 'function' 'w' ('(' ')')? 'nl'* compound redirect*
simple: part+
part: word | redirect | 'w' '=(' (word | 'nl')* ')' | '=(' (word | 'nl')* ')'
word: 'w' ('$(' 'nl'* list? ')')*
redirect: 'redir' word
compound: '{' 'nl'* list '}' | '(' 'nl'* list ')' | '((' | '[[' cond+ ']]'
compound: 'if' 'nl'* list 'then' 'nl'* list ('elif' 'nl'* list 'then' 'nl'* list)* ('else' 'nl'* list)? 'fi'
compound: ('while' | 'until') 'nl'* list 'do' 'nl'* list 'done'
compound: ('for' | 'select') ('w' 'nl'* ('in' word* (';' | 'nl') 'nl'* | ';' 'nl'*)? | '((' (';' | 'nl')? 'nl'*) ('do' 'nl'* list 'done' | '{' 'nl'* list '}')
compound: 'case' word 'nl'* 'in' 'nl'* (clause ';;' 'nl'*)* (clause)? 'esac'
clause: '('? word+ ('|' word+)* ')' 'nl'* list?
cond: word | '&&' | '||' | '!' | '(' | ')' | 'redir' | 'nl'
"""

PYTHON = """
shape: statement*
statement: simples | compound
simples: simple (';' simple)* ';'? 'nl'
suite: simples | 'nl' 'indent' statement+ 'dedent'
name: 'id' | 'match' | 'case' | 'type' | '_'
simple: exprs | (targets '=')+ (yield | exprs) | single 'assignop' (yield | exprs) | single ':' expr ('=' (yield | exprs))? | yield | 'pass' | 'break' | 'continue'
simple: 'return' exprs? | 'raise' (expr ('from' expr)?)? | ('global' | 'nonlocal') name (',' name)* | 'del' gone (',' gone)* ','? | 'assert' expr (',' expr)?
simple: 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' ('.' | '...')* dotted 'import' imports | 'from' ('.' | '...')+ 'import' imports
simple: 'type' name tparams? '=' expr
imports: '*' | imported | '(' imported ','? ')'
imported: name ('as' name)? (',' name ('as' name)?)*
dotted: name ('.' name)*
place: name | primary '.' name | primary '[' slices ']'
single: place | '(' single ')'
targets: target (',' target)* ','?
target: '*'? (place | '(' targets? ')' | '[' targets? ']')
gone: place | '(' (gone (',' gone)* ','?)? ')' | '[' (gone (',' gone)* ','?)? ']'
compound: ('@' named 'nl')* 'async'? 'def' name tparams? '(' params ')' ('->' expr)? ':' suite | ('@' named 'nl')* 'class' name tparams? ('(' bases ')')? ':' suite
compound: 'if' named ':' suite ('elif' named ':' suite)* else? | 'while' named ':' suite else? | 'async'? 'for' targets 'in' exprs ':' suite else?
compound: 'try' ':' suite (except+ else? finally? | group+ else? finally? | finally) | 'async'? 'with' items ':' suite
compound: 'match' subject ':' 'nl' 'indent' case+ 'dedent'
else: 'else' ':' suite
finally: 'finally' ':' suite
except: 'except' (expr ('as' name)?)? ':' suite
group: 'except' '*' expr ('as' name)? ':' suite
items: item (',' item)* | '(' item (',' item)* ','? ')'
item: expr ('as' target)?
subject: named | starred ',' | starred (',' starred)+ ','?
case: 'case' patterns ('if' named)? ':' suite
patterns: pattern | part ',' | part (',' part)+ ','?
part: '*' name | pattern
pattern: closed ('|' closed)* ('as' name)?
closed: literal | dotted | '(' pattern ')' | '(' (part ',' | part (',' part)+ ','?)? ')' | '[' (part (',' part)* ','?)? ']' | '{' (entry (',' entry)* ','?)? '}'
closed: dotted '(' (pattern (',' pattern)* (',' name '=' pattern)* ','? | name '=' pattern (',' name '=' pattern)* ','?)? ')'
literal: '-'? 'num' (('+' | '-') 'num')? | text | 'None' | 'True' | 'False'
entry: (literal | name ('.' name)+) ':' pattern | '**' name
tparams: '[' tparam (',' tparam)* ','? ']'
tparam: name (':' expr)? ('=' expr)? | '*' name ('=' starexpr)? | '**' name ('=' expr)?
params: (front (',' back)? ','? | back ','?)?
front: plains | slashed | defaults | dslashed
plains: par | plains ',' par
slashed: plains ',' '/' | slashed ',' par
defaults: dpar | plains ',' dpar | slashed ',' dpar | defaults ',' dpar
dslashed: defaults ',' '/' | dslashed ',' dpar
back: '*' spar (',' (par | dpar))* (',' rest)? | '*' (',' (par | dpar))+ (',' rest)? | rest
rest: '**' par
par: name (':' expr)?
dpar: par '=' expr
spar: name (':' starexpr)?
lparams: (lfront (',' lback)? ','? | lback ','?)?
lfront: lplains | lslashed | ldefaults | ldslashed
lplains: name | lplains ',' name
lslashed: lplains ',' '/' | lslashed ',' name
ldefaults: ldpar | lplains ',' ldpar | lslashed ',' ldpar | ldefaults ',' ldpar
ldslashed: ldefaults ',' '/' | ldslashed ',' ldpar
lback: '*' name (',' (name | ldpar))* (',' '**' name)? | '*' (',' (name | ldpar))+ (',' '**' name)? | '**' name
ldpar: name '=' expr
exprs: starexpr (',' starexpr)* ','?
starexpr: '*' arith | expr
starred: '*' arith | named
starreds: starred (',' starred)* ','?
named: name ':=' expr | expr
yield: 'yield' exprs? | 'yield' 'from' expr
expr: either ('if' either 'else' expr)? | 'lambda' lparams ':' expr
either: both ('or' both)*
both: 'not'* compared ('and' 'not'* compared)*
compared: arith (('<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not') arith)*
arith: unary (('+' | '-' | '*' | '/' | '//' | '%' | '@' | '<<' | '>>' | '&' | '|' | '^') unary)*
unary: ('+' | '-' | '~')* 'await'? primary ('**' unary)?
primary: atom tail*
tail: '.' name | '(' args ')' | '[' slices ']'
slices: slice (',' slice)* ','?
slice: starred | expr? ':' expr? (':' expr?)?
args: bases | named comp+
bases: (given (',' given)* (',' keyword)* ','? | keyword (',' keyword)* ','?)?
given: named | '*' expr
keyword: name '=' expr (',' (name '=' expr | '*' expr))* | '**' expr (',' (name '=' expr | '**' expr))*
atom: name | 'num' | text | 'None' | 'True' | 'False' | '...' | '(' (yield | named) ')' | '(' (starred ',' starreds?)? ')' | '(' named comp+ ')'
atom: '[' starreds? ']' | '[' named comp+ ']' | '{' starreds '}' | '{' named comp+ '}' | '{' (pair (',' pair)* ','?)? '}' | '{' expr ':' expr comp+ '}'
pair: expr ':' expr | '**' arith
comp: 'async'? 'for' targets 'in' either ('if' either)*
text: ('str' | 'f(' field* 'f)')+ | 'bytes'+
field: 'f{' (exprs | yield) '='? ('!' name)? ('f:' field*)? 'f}'
"""


@cache
def grammar(language: str) -> Grammar:
    text = {"rust": RUST, "javascript": SCRIPT, "typescript": SCRIPT + TYPES, "bash": BASH, "python": PYTHON}[language]
    return Grammar(text, "shape")


LANGUAGES = ["rust", "javascript", "typescript", "bash", "python"]
